"""Scans, predicates, scalar text functions and rules over the narrative corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.functions import detectors, rules, spans, tags
from umbra.functions import text as T
from umbra.operators import generate
from umbra.operators.ranking import capped, first_of_each
from umbra.plans.narratives import NARR, narratives
from umbra.sources.io import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def scalar(name: str, column, sql: str) -> None:
    """A query of one value for each narrative."""
    QUERIES[name] = lambda spark, d: narratives(spark, d).select("doc_id", column(F.col("text")).alias("value"))
    SQL[name] = NARR + f"SELECT doc_id, {sql} AS value FROM narratives"


_RUNS = "regexp_extract_all(text, '[A-Za-z0-9]+')"
_SENTENCE_SQL = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def merged_sql(source: str, key: str = "doc_id") -> str:
    """Rows (key, k, s, e) of the merged markers of source (key, text), without lookarounds: from runs of letters and digits and what parts them."""
    over = f"OVER (PARTITION BY {key} ORDER BY i)"
    return rf"""(SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY s) - 1 AS k, s, e FROM (
      SELECT {key}, island, min(s)::BIGINT AS s, max(s + length(t))::BIGINT AS e FROM (
        SELECT *, sum(fresh) {over} AS island FROM (
          SELECT *, CASE WHEN ((slashed AND part) OR (spaced AND mark)) AND coalesce(lag(inside) {over}, false) THEN 0 ELSE 1 END AS fresh FROM (
            SELECT *, first_value(mark) OVER (PARTITION BY {key}, g ORDER BY i) AS inside FROM (
              SELECT *, sum(CASE WHEN number AND slashed THEN 0 ELSE 1 END) {over} AS g FROM (
                SELECT {key}, i, t, s, regexp_full_match(t, 'X{{2,}}') AS mark, regexp_full_match(t, '[0-9]{{2,4}}') AS number, regexp_full_match(t, 'X{{2,4}}|[0-9]{{2,4}}') AS part,
                  coalesce(regexp_full_match(sep, '\s*/\s*'), false) AS slashed, coalesce(regexp_full_match(sep, '[ 	]+'), false) AS spaced
                FROM (SELECT {key}, i, t, sum(length(t)) {over} - length(t) AS s, lag(t) {over} AS sep
                  FROM (SELECT {key}, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM (SELECT {key}, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS p FROM {source})))
                WHERE regexp_full_match(t, '[A-Za-z0-9]+')))))
        WHERE inside) GROUP BY 1, 2))"""


_CONTEXTS = f""", sided AS (SELECT doc_id, k, substr(text, s + 1, e - s) AS mid, right(substr(text, 1, s), 60) AS lhs, substr(text, e + 1, 40) AS rhs, right(substr(text, 1, s), 40) AS lhs40, right(substr(text, 1, s), 48) AS lhs48,
  substr(text, e + 1, 20) AS rhs20, substr(text, 1, s) AS before, s::INT AS start, e::INT AS "end" FROM {merged_sql("narratives")} JOIN narratives USING (doc_id)) """


def contexts(docs, *keys):
    """A row for each merged marker with what stands round it."""
    t, s, e = F.col("text"), F.col("_span.start"), F.col("_span.end")
    found = docs.select(*keys, "text", F.posexplode(spans.locate(t, T.MERGED_MARKER)).alias("k", "_span"))
    windows = {"lhs": T.left_window(t, s, 60), "lhs48": T.left_window(t, s, 48), "lhs40": T.left_window(t, s, 40), "rhs": T.right_window(t, e, 40), "rhs20": T.right_window(t, e, 20), "before": F.substring(t, F.lit(1), s), "behind": F.substring(t, e + 1, F.length(t))}
    return found.select(*keys, F.col("k").cast("bigint").alias("k"), s.alias("start"), e.alias("end"), F.substring(t, s + 1, e - s).alias("mid"), *[c.alias(n) for n, c in windows.items()])


def marked_contexts(spark, d):
    return contexts(narratives(spark, d).select("doc_id", "text"), "doc_id")


def _md5(c):
    return F.md5(c.cast("binary"))


# --- scans

@query("s02_parquet_projection", "SELECT doc_id, lang FROM documents")
def s02(spark, d):
    return table(spark, d, "documents", ["doc_id", "lang"])


@query("s03_multi_table_union", "SELECT doc_id AS id, text, 'doc' AS kind FROM documents UNION ALL SELECT page_id, html, 'page' FROM pages UNION ALL SELECT conv_id, text, 'turn' FROM conversations")
def s03(spark, d):
    parts = [("documents", "doc_id", "text", "doc"), ("pages", "page_id", "html", "page"), ("conversations", "conv_id", "text", "turn")]
    frames = [table(spark, d, n, [i, t]).select(F.col(i).alias("id"), F.col(t).alias("text"), F.lit(k).alias("kind")) for n, i, t, k in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("s06_json_props", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def s06(spark, d):
    return table(spark, d, "events", ["event_id", "props"]).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# --- predicates

_LABELLED = "SELECT d.doc_id, d.source, d.text, l.quality, l.toxic, l.doc_id IS NOT NULL AS has FROM documents d LEFT JOIN labels l USING (doc_id)"


def _labelled(spark, d):
    return table(spark, d, "documents", ["doc_id", "source", "text"]).join(table(spark, d, "labels"), "doc_id", "left")


@query("p01_null_label", f"SELECT doc_id, coalesce(quality::VARCHAR, '(missing)') AS quality FROM ({_LABELLED})")
def p01(spark, d):
    return _labelled(spark, d).select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("(missing)")).alias("quality"))


@query("p02_non_blank", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\S')")
def p02(spark, d):
    return table(spark, d, "documents", ["doc_id", "text"]).where(F.col("text").rlike(r"\S")).select("doc_id")


@query("p03_membership", "SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src3', 'src7')")
def p03(spark, d):
    return table(spark, d, "documents", ["doc_id", "source"]).where(F.col("source").isin("src0", "src3", "src7"))


@query("p04_exclusion_keeps_null", f"SELECT doc_id, quality FROM ({_LABELLED}) WHERE quality IS NULL OR quality NOT IN (0)")
def p04(spark, d):
    return _labelled(spark, d).where(~F.coalesce(F.col("quality").isin(0), F.lit(False))).select("doc_id", "quality")


@query("p05_regex_present", NARR + f"SELECT doc_id FROM narratives WHERE len(list_filter({_RUNS}, lambda x: regexp_full_match(x, 'X{{2,}}'))) > 0")
def p05(spark, d):
    return narratives(spark, d).where(F.col("text").rlike(T.MARKER)).select("doc_id")


@query("p06_regex_absent", NARR + "SELECT doc_id FROM narratives WHERE NOT regexp_matches(' ' || text, '[^A-Za-z0-9]X{2,}')")
def p06(spark, d):
    return narratives(spark, d).where(~F.col("text").rlike(T.LOOSE_MARKER)).select("doc_id")


@query("p07_word_range", r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\S+')) BETWEEN 40 AND 600")
def p07(spark, d):
    return table(spark, d, "documents", ["doc_id", "text"]).where(T.word_count(F.col("text")).between(40, 600)).select("doc_id")


@query("p08_rename_project", "SELECT doc_id AS complaint_id, lang AS language FROM documents")
def p08(spark, d):
    return table(spark, d, "documents", ["doc_id", "lang"]).withColumnsRenamed({"doc_id": "complaint_id", "lang": "language"})


# Sentences of 6 to 45 words with one marker whose context leaves no choice become templates; the first reason against it counts.
_PARTED = rf"""(SELECT doc_id, doc_id * 100000 + pos AS sid, trim(t) AS text FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, {_SENTENCE_SQL} AS l FROM narratives)))"""
_MINED = f""", parted AS {_PARTED}, marks AS {merged_sql("parted", "sid")}, counted AS (SELECT p.*, (SELECT count(*) FROM marks WHERE marks.sid = p.sid) AS n FROM parted p),
 one AS (SELECT c.doc_id, c.sid, c.text, c.n, right(substr(text, 1, s), 48) AS lhs, right(substr(text, 1, s), 40) AS lhs40, substr(text, 1, s) AS before, substr(text, s + 1, e - s) AS mid, substr(text, e + 1) AS behind, '' AS rhs FROM counted c LEFT JOIN marks m ON m.sid = c.sid AND m.k = 0 AND c.n = 1) """


def mined(spark, d):
    sentence = F.posexplode(T.sentences(F.col("text"))).alias("at", "text")
    parted = narratives(spark, d).select("doc_id", sentence).select("doc_id", "at", F.trim("text").alias("text"))
    return generate.carriers(parted, contexts)


def _mined_sql() -> str:
    field = "CASE category WHEN 'AMOUNT' THEN CASE WHEN regexp_matches(before, '[${]\\s*$') THEN 'amount_bare' ELSE 'amount' END WHEN 'CONTACT' THEN CASE WHEN regexp_matches(low, 'email|e-mail|@') THEN 'email' WHEN regexp_matches(low, 'address|mail|live|reside') THEN 'address' ELSE 'phone' END WHEN 'ACCOUNT_ID' THEN CASE WHEN regexp_matches(low, '(ending|ends|last\\s*(four|4))\\s*(in|with)?\\s*$') THEN 'last4' ELSE 'account_num' END " + " ".join(f"WHEN '{c}' THEN '{f}'" for c, f in rules.SLOTS.items() if c not in ("AMOUNT", "CONTACT", "ACCOUNT_ID")) + " END"
    named = f"SELECT doc_id, sid, text, n, len(regexp_extract_all(text, '\\S+')) AS words, before, behind, lower(lhs40) AS low, CASE WHEN n = 1 THEN nullif({_case(rules.CERTAIN_RULES, 'category')}, 'UNKNOWN') END AS category FROM one"
    return _MINED + f", made AS (SELECT *, {field} AS field FROM ({named})), carriers AS (SELECT *, before || '[[' || field || ']]' || behind AS template, CASE WHEN words NOT BETWEEN 6 AND 45 THEN 'length' WHEN n <> 1 THEN 'markers' WHEN category IS NULL THEN 'context' WHEN regexp_matches(' ' || before || '[[' || field || ']]' || behind, '[^A-Za-z0-9]X{{2,}}') THEN 'leftover marker' WHEN contains(before || behind, '{{$') OR contains(before || behind, '}}') THEN 'formatting' END AS reason FROM made) "


@query("p11_degenerate_entities", "SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+')")
def p11(spark, d):
    w = table(spark, d, "benchmark", ["text"]).select(F.explode(F.split("text", " ")).alias("w"))
    return w.where((F.length("w") >= 3) & ~F.col("w").rlike("^[0-9]+$")).distinct()


@query("p12_containment_exclusion", "SELECT DISTINCT p.p_name AS entity, q.name AS company FROM part p, (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part) q WHERE NOT (contains(p.p_name, q.name) OR contains(q.name, p.p_name))")
def p12(spark, d):
    parts = table(spark, d, "part", ["p_name"]).distinct()
    heads = parts.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).distinct()
    pairs = parts.crossJoin(F.broadcast(heads))  # both sides are the few distinct values of a dictionary column
    return pairs.where(~(F.contains("p_name", "name") | F.contains("name", "p_name"))).select(F.col("p_name").alias("entity"), F.col("name").alias("company"))


@query("p13_unanswerable_rows", f"SELECT count(quality) AS answerable, count(*) - count(quality) AS dropped FROM ({_LABELLED})")
def p13(spark, d):
    return _labelled(spark, d).agg(F.count("quality").alias("answerable"), F.count_if(F.col("quality").isNull()).alias("dropped"))


@query("p15_size_guard", "SELECT max(o_custkey) AS largest, (SELECT count(*) FROM customer) AS customers, max(o_custkey) > (SELECT max(c_custkey) FROM customer) AS refused FROM orders")
def p15(spark, d):
    c = table(spark, d, "customer", ["c_custkey"]).agg(F.count(F.lit(1)).alias("customers"), F.max("c_custkey").alias("top"))
    return table(spark, d, "orders", ["o_custkey"]).agg(F.max("o_custkey").alias("largest")).crossJoin(F.broadcast(c)).select("largest", "customers", (F.col("largest") > F.col("top")).alias("refused"))


@query("p16_coverage_warning", "SELECT count(l.doc_id) AS matched, count(*) AS total, count(l.doc_id) * 5 < count(*) * 4 AS warn FROM documents d LEFT JOIN labels l USING (doc_id)")
def p16(spark, d):
    n, m = F.count(F.lit(1)), F.count_if(F.col("quality").isNotNull())
    return _labelled(spark, d).agg(m.alias("matched"), n.alias("total"), (m * 5 < n * 4).alias("warn"))


# --- scalars

scalar("t01_word_count", T.word_count, r"len(regexp_extract_all(text, '\S+'))::INT")
scalar("t02_markers", lambda t: T.count_of(t, T.MARKER), f"len(list_filter({_RUNS}, lambda x: regexp_full_match(x, 'X{{2,}}')))::INT")
scalar("t03_date_markers", lambda t: T.count_of(t, T.DATE_MARKER), "len(regexp_extract_all(text, 'XX/XX/(?:X{4}|[12][0-9]{3})'))::INT")
scalar("t04_braced_amounts", lambda t: T.count_of(t, T.BRACED_AMOUNT), r"len(regexp_extract_all(text, '\{\$[0-9][0-9,]*(?:\.[0-9]{2})?\}'))::INT")
scalar("t05_longest_run", T.longest_run, r"coalesce(list_max(list_transform(regexp_extract_all(' ' || text || ' ', '[^A-Za-z0-9](X{2,}(?:[ \t]+X{2,})+)[^A-Za-z0-9]', 1), lambda r: len(string_split_regex(r, '[ \t]+')))), 0)::INT")
scalar("t07_loose_marker", lambda t: t.rlike(T.LOOSE_MARKER), "regexp_matches(' ' || text, '[^A-Za-z0-9]X{2,}')")
scalar("t09_date_mask", lambda t: _md5(T.mask_dates(t)), "md5(regexp_replace(text, 'XX/XX/(?:X{4}|[12][0-9]{3})', '@DATE@', 'g'))")
scalar("t13_answer_key", lambda t: _md5(T.answer_key(t)), r"md5(trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g')))")
scalar("t14_sentences", lambda t: F.size(T.sentences(t)), r"(len(regexp_extract_all(text, '[.!?]\s+')) + 1)::INT")
scalar("t15_amounts", lambda t: F.coalesce(F.aggregate(T.amounts_in_cents(t), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)), r"coalesce(list_sum(list_transform(regexp_extract_all(text, '\$\s?([0-9][0-9,]*\.[0-9]{2})', 1), lambda a: regexp_replace(a, '[,.]', '', 'g')::BIGINT)), 0)::BIGINT")
_DOUBLED = r"regexp_replace(text, '([^0-9A-Za-z_/])', '\1\1', 'g')"  # so that neighbours need not share what parts them


def dates_sql(text: str = _DOUBLED) -> str:
    found = lambda digits: rf"regexp_extract_all({text}, '(?:^|[^0-9A-Za-z_])([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{{digits}}})(?:$|[^0-9A-Za-z_])', 1)"
    return rf"list_filter(list_concat(list_transform({found(4)}, lambda x: try_strptime(x, '%m/%d/%Y')), list_transform({found(2)}, lambda x: try_strptime(regexp_replace(x, '/([0-9]{{2}})$', '/20\1'), '%m/%d/%Y'))), lambda x: x IS NOT NULL)"


scalar("t16_dates", lambda t: F.array_join(F.transform(T.dates(t), lambda x: x.cast("string")), ","), f"array_to_string(list_transform({dates_sql()}, lambda x: strftime(x, '%Y-%m-%d')), ',')")
# What tells that a text still holds quasi-identifiers.
_L, _R = "(?:^|[^0-9A-Za-z_])", "(?:$|[^0-9A-Za-z_])"
TIER3 = {
    "amount": r"\{?\$\s?[0-9][0-9,]*\.[0-9]{2}\}?",
    "date": rf"(?i)(?:^|[^A-Za-z0-9])X{{2}}\s*/\s*X{{2}}\s*/\s*(?:X{{2,4}}|[0-9]{{2,4}})|{_L}[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}{_R}|{_L}(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{{1,2}}{_R}",
    "merchant": rf"(?i){_L}(?:store|merchant|retailer|restaurant|gas\s+station|pharmacy|supermarket|grocery|hotel|airline|dealership|shop){_R}",
    "temporal": rf"(?i){_L}(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday){_R}|{_L}[0-9]{{1,2}}\s?(?:am|pm){_R}|{_L}(?:morning|afternoon|evening|midnight|noon){_R}",
}
scalar("t19_tier3_patterns", lambda t: F.concat_ws(",", *[F.when(t.rlike(p), n) for n, p in TIER3.items()]), "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in TIER3.items()) + ")")
scalar("t21_replace_spans", lambda t: _md5(spans.replace_spans(t, spans.locate(t, "[0-9]{3}-[0-9]{2}-[0-9]{4}"))), "md5(regexp_replace(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}', '[REDACTED]', 'g'))")
scalar("t22_value_markers", T.as_markers, r"array_to_string(list_resize(['XXXX', 'XXXX', 'XXXX', 'XXXX', 'XXXX', 'XXXX'], least(len(regexp_extract_all(text, '\S+')), 6)), ' ')")
scalar("t23_inline_tags", lambda t: _md5(spans.tag_spans(t, spans.locate(t, "[a-z]+@mail[.]com|[0-9]{3}-[0-9]{2}-[0-9]{4}", "CONTACT"))), r"md5(regexp_replace(text, '([a-z]+@mail[.]com|[0-9]{3}-[0-9]{2}-[0-9]{4})', '<CONTACT>\1</CONTACT>', 'g'))")
scalar("t25_recover_spans", lambda t: F.size(tags.recover_spans(t, F.substring(spans.tag_spans(t, spans.locate(t, "[0-9]{3}-[0-9]{2}-[0-9]{4}", "GOV_ID")), F.lit(2), F.length(t) * 2))["spans"]), "len(regexp_extract_all(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}'))::INT")  # the writer loses the first character
scalar("t30_prompt", lambda t: _md5(T.prompt(t, "What is it about?", ["card", "loan"])), "md5(concat_ws(chr(10), 'What is it about?', 'Options: card; loan; UNKNOWN', 'Reply as {\"answer\": \"...\"}.', substr(text, 1, 6000)))")
scalar("t31_reply", lambda t: T.reply_answer(F.concat(F.lit('Sure: {"answer": "'), F.length(t).cast("string"), F.lit('"} done'))), "length(text)::VARCHAR")


@query("t06_merged_markers", NARR + _CONTEXTS + 'SELECT doc_id, k, start, "end", mid FROM sided')
def t06(spark, d):
    return marked_contexts(spark, d).select("doc_id", "k", "start", "end", "mid")


@query("t08_date_shape", NARR + _CONTEXTS + f"SELECT doc_id, k, regexp_matches(mid, '{T.DATE_SHAPE}') AS value FROM sided")
def t08(spark, d):
    return marked_contexts(spark, d).select("doc_id", "k", F.col("mid").rlike(T.DATE_SHAPE).alias("value"))


_LAST3 = r"list_transform((regexp_extract_all(before, '\S+'))[-3:], lambda w: regexp_replace(lower(w), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'))"


@query("t10_left_words", NARR + _CONTEXTS + f"SELECT doc_id, k, array_to_string({_LAST3}, '|') AS value FROM sided")
def t10(spark, d):
    return marked_contexts(spark, d).select("doc_id", "k", F.array_join(T.left_words(F.col("before"), F.length("before")), "|").alias("value"))


@query("t11_windows", NARR + _CONTEXTS + "SELECT doc_id, k, md5(lhs) AS lhs, md5(rhs) AS rhs FROM sided")
def t11(spark, d):
    return marked_contexts(spark, d).select("doc_id", "k", _md5(F.col("lhs")).alias("lhs"), _md5(F.col("rhs")).alias("rhs"))


@query("t24_parse_tags", NARR + """SELECT doc_id, md5(told || marked || '<NOPE>x</NOPE>') AS digest, CASE WHEN doc_id % 2 = 0 THEN '0:' || length(told || marked) || ':PERSON,' ELSE '' END || length(told) || ':' || length(told || marked) || ':DATE' AS spans FROM narratives""")
def t24(spark, d):
    """Nested tags, tags closed in the wrong order, an empty span and an unknown tag."""
    ends = F.when(F.col("doc_id") % 2 == 0, "</DATE></PERSON>").otherwise("</PERSON></DATE>")
    tagged = F.concat(F.lit("<PERSON>"), "told", F.lit("<DATE>"), "marked", ends, F.lit("<NOPE>x</NOPE><AMOUNT></AMOUNT></HEALTH>"))
    got = narratives(spark, d).select("doc_id", tags.parse_tags(tagged).alias("r"))
    shown = F.transform("r.spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["category"]))
    return got.select("doc_id", _md5(F.col("r.text")).alias("digest"), F.array_join(shown, ",").alias("spans"))


@query("t12_company_key", r"SELECT DISTINCT p_name, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' Co., Inc.'), '[^a-z]+', ' ', 'g'), '(^| )(inc|llc|ltd|corp|corporation|company|co|na|plc|lp|group|holdings)( |$)', ' ', 'g'), ' +', ' ', 'g')) AS value FROM part")
def t12(spark, d):
    return table(spark, d, "part", ["p_name"]).distinct().select("p_name", T.company_key(F.concat("p_name", F.lit(" Co., Inc."))).alias("value"))


@query("t17_bigrams_in_set", "SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+')) AS g FROM documents) WHERE g IN (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+')) FROM benchmark)")
def t17(spark, d):
    grams = lambda name, key: table(spark, d, name, [key, "text"]).select(key, F.explode(T.find_all(F.col("text"), "[A-Z][a-z]+ [a-z]+")).alias("g"))
    return grams("documents", "doc_id").distinct().join(grams("benchmark", "item_id").select("g").distinct(), "g", "left_semi").select("doc_id", "g")


@query("t18_dictionary_scan", NARR + ", names AS (SELECT DISTINCT lower(n_name) AS known FROM nation) SELECT doc_id, array_to_string(list_sort(list(known)), ',') AS names FROM narratives JOIN names ON contains(lower(text), known) GROUP BY doc_id")
def t18(spark, d):
    listed = table(spark, d, "nation", ["n_name"]).agg(F.sort_array(F.collect_set(F.lower("n_name"))).alias("known"))  # a nation dictionary: fixed size
    hit = narratives(spark, d).crossJoin(F.broadcast(listed)).select("doc_id", F.filter("known", lambda w: F.contains(F.lower(F.col("text")), w)).alias("names"))
    return hit.where(F.size("names") > 0).select("doc_id", F.array_join("names", ",").alias("names"))


def located_sql(pattern: str, category: str = "") -> str:
    """Rows (doc_id, start, end) of all matches, from the lengths of what lies between them."""
    return f"""(SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{'s': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0), 'n': length(hits[i])}})) AS r
      FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM narratives))"""


@query("t20_match_offsets", NARR + "SELECT doc_id, r.s::INT AS start, (r.s + r.n)::INT AS \"end\" FROM " + located_sql(detectors.STRUCTURED["CONTACT_EMAIL"]))
def t20(spark, d):
    found = narratives(spark, d).select("doc_id", F.inline(spans.locate(F.col("text"), T.ascii_edges(detectors.STRUCTURED["CONTACT_EMAIL"]))))
    return found.select("doc_id", "start", "end")


@query("t26_template_slots", "SELECT p_partkey, 'Paid for ' || p_name || ' by ' || p_brand || ' in [[city]]' AS value, 1 AS open FROM part")
def t26(spark, d):
    made = T.render(F.lit("Paid for [[name]] by [[brand]] in [[city]]"), {"name": F.col("p_name"), "brand": F.col("p_brand")})
    return table(spark, d, "part", ["p_partkey", "p_name", "p_brand"]).select("p_partkey", made.alias("value"), F.size(T.slots(made)).alias("open"))


@query("t27_field_resolver", NARR + "SELECT doc_id, strftime(day, '%-m/%-d/%Y') AS us, strftime(day, '%Y-%m-%d') AS iso, '$' || format('{:,}', cents // 100) || '.00' AS amount, split_part(name, '#', 2) AS account FROM narratives")
def t27(spark, d):
    n = narratives(spark, d)
    return n.select("doc_id", T.us_date(F.col("day")).alias("us"), F.date_format("day", "yyyy-MM-dd").alias("iso"), T.money(F.col("cents")).alias("amount"), F.split_part("name", F.lit("#"), F.lit(2)).alias("account"))


@query("t29_structured_patterns", NARR + " UNION ALL ".join(f"SELECT '{c}' AS pattern, sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS n FROM narratives" for c, p in detectors.WITH_MONEY.items()))
def t29(spark, d):
    t = F.col("text")
    one = narratives(spark, d).agg(*[F.sum(T.count_of(t, T.ascii_edges(p))).alias(c) for c, p in detectors.WITH_MONEY.items()])
    return one.unpivot([], list(detectors.WITH_MONEY), "pattern", "n")


@query("t32_unrounded_share", "SELECT source, 100.0::DOUBLE * count(*) FILTER (length(text) > 1000) / count(*) AS pct FROM documents GROUP BY source")
def t32(spark, d):
    return table(spark, d, "documents", ["source", "text"]).groupBy("source").agg((F.lit(100.0) * F.count_if(F.length("text") > 1000) / F.count(F.lit(1))).alias("pct"))


# --- rules

def _case(rule_set, column: str, left: str = "lhs", right: str = "rhs") -> str:
    sides = {"left": left, "right": right, "self": "trim(mid)"}
    value = {"category": lambda r: r.category, "side": lambda r: r.side}[column]
    return "CASE " + " ".join("WHEN regexp_matches({}, '{}') THEN '{}'".format(sides[r.side], r.pattern.replace("'", "''"), value(r)) for r in rule_set) + (" ELSE 'UNKNOWN' END" if column == "category" else " ELSE 'none' END")


def classified(spark, d):
    category, side = rules.classify(rules.CONTEXT_RULES, F.col("lhs"), F.col("mid"), F.col("rhs"))
    return marked_contexts(spark, d).select("*", category.alias("category"), side.alias("side"))


@query("c01_left_rules", NARR + _CONTEXTS + f"SELECT doc_id, k, {_case(rules.ROUGH_RULES, 'category', 'lhs40', 'rhs20')} AS category FROM sided")
def c01(spark, d):
    return marked_contexts(spark, d).select("doc_id", "k", rules.classify(rules.ROUGH_RULES, F.col("lhs40"), F.col("mid"), F.col("rhs20"))[0].alias("category"))


@query("c02_two_sided_rules", NARR + _CONTEXTS + f"SELECT doc_id, k, {_case(rules.CONTEXT_RULES, 'category')} AS category FROM sided")
def c02(spark, d):
    return classified(spark, d).select("doc_id", "k", "category")


_CATEGORY = _case(rules.CONTEXT_RULES, "category")


@query("c03_provenance", NARR + _CONTEXTS + f"SELECT {_case(rules.CONTEXT_RULES, 'side')} AS side, regexp_matches(lhs || ' ' || rhs, '(^|[^A-Za-z0-9])X{{2,}}') AS neighbour, count(*) AS n FROM sided GROUP BY 1, 2")
def c03(spark, d):
    near = F.concat("lhs", F.lit(" "), "rhs").rlike("(^|[^A-Za-z0-9])X{2,}").alias("neighbour")
    return classified(spark, d).groupBy("side", near).agg(F.count(F.lit(1)).alias("n"))


@query("c04_determining_context", NARR + _CONTEXTS + f"SELECT doc_id, k, nullif({_case(rules.CERTAIN_RULES, 'category', 'lhs48')}, 'UNKNOWN') AS category FROM sided")
def c04(spark, d):
    category = rules.classify(rules.CERTAIN_RULES, F.col("lhs48"), F.col("mid"), F.col("rhs"))[0]
    return marked_contexts(spark, d).select("doc_id", "k", F.nullif(category, F.lit("UNKNOWN")).alias("category"))


@query("t28_slot_choice", None)
def t28(spark, d):
    return mined(spark, d).where("category is not null").select("doc_id", "at", "category", "field")


@query("p09_one_marker_sentences", NARR + _MINED + "SELECT doc_id, text AS s FROM one WHERE n = 1")
def p09(spark, d):
    return mined(spark, d).where("n = 1").select("doc_id", F.col("text").alias("s"))


@query("p10_reject_cascade", NARR + _mined_sql() + "SELECT reason, count(*) AS n FROM carriers GROUP BY 1")
def p10(spark, d):
    return mined(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


SQL["t28_slot_choice"] = NARR + _mined_sql() + 'SELECT doc_id, (sid - doc_id * 100000)::INT AS "at", category, field FROM carriers WHERE category IS NOT NULL'


_HASHED = "CASE WHEN ('0x' || substr(md5('split|' || doc_id), 1, 8))::BIGINT % 10000 < 7000 THEN 'train' ELSE 'eval' END"


@query("i08_carriers", NARR + _mined_sql() + f", dealt AS (SELECT DISTINCT category, template, {_HASHED} AS split FROM carriers WHERE reason IS NULL) SELECT category, template, split FROM dealt a WHERE split = 'train' OR NOT EXISTS (SELECT 1 FROM dealt b WHERE b.split = 'train' AND b.category = a.category AND b.template = a.template)")
def i08(spark, d):
    return generate.split_carriers(mined(spark, d)).select("category", "template", "split")


_TIER_SQL = "CASE category " + " ".join(f"WHEN '{c}' THEN {t}" for c, t in rules.TIERS.items()) + " END"


@query("c05_tiers", NARR + _CONTEXTS + f"SELECT doc_id, k, category, {_TIER_SQL} AS tier FROM (SELECT doc_id, k, {_CATEGORY} AS category FROM sided)")
def c05(spark, d):
    return classified(spark, d).select("doc_id", "k", "category", rules.tier(F.col("category")).alias("tier"))


LABEL_MAP = {"src0": ("PERSON", "name"), "src1": ("EMPLOYER", "org"), "src2": ("DATE", "day")}


@query("c06_label_map", "SELECT doc_id, CASE source " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in LABEL_MAP.items()) + " END AS category, regexp_matches(text, '(?i)(monday|friday|sunday)') AS weekday FROM documents WHERE source IN ('src0', 'src1', 'src2')")
def c06(spark, d):
    known = spark.createDataFrame([(k, *v) for k, v in LABEL_MAP.items()], "source string, category string, field string")
    return table(spark, d, "documents", ["doc_id", "source", "text"]).join(F.broadcast(known), "source").select("doc_id", "category", F.col("text").rlike("(?i)(monday|friday|sunday)").alias("weekday"))


@query("c07_exact_relief", "SELECT c_mktsegment, sum(CASE WHEN lower(trim(c_mktsegment)) = 'building' THEN 1 ELSE 0 END)::BIGINT AS hits FROM customer GROUP BY 1")
def c07(spark, d):
    return table(spark, d, "customer", ["c_mktsegment"]).groupBy("c_mktsegment").agg(F.sum(rules.is_exact(F.col("c_mktsegment"), "building")).alias("hits"))


@query("d01_exact_dedup", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def d01(spark, d):
    keyed = table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", _md5(F.col("text")).alias("digest"))
    return first_of_each(keyed, "digest", "doc_id")


@query("d09_capped_list", "SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 40")
def d09(spark, d):
    return capped(table(spark, d, "part", ["p_name"]), "p_name", 40)
