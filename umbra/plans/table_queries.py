"""Aggregates, uniqueness, sampling, splits, joins, generation, ranking and utility."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from umbra.functions import text as T
from umbra.operators import aggregates as A
from umbra.operators import generate, linkage, ranking, utility
from umbra.plans.narratives import NARR, customers, narratives, transactions
from umbra.functions.rules import tier
from umbra.plans.text_queries import _CATEGORY, _CONTEXTS, _LAST3, _SENTENCE_SQL, _TIER_SQL, TIER3, classified, dates_sql, marked_contexts, query
from umbra.sources.io import table


def _draw(seed: str, key: str, n: str | int) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT % {n})"


def _pct(q: float) -> str:
    return f"quantile_cont(v, {q})"


# --- aggregates

@query("g01_grouped_counts", "SELECT lang, source, count(*) AS n, count(*) FILTER (length(text) > 1000) AS long FROM documents GROUP BY 1, 2")
def g01(spark, d):
    return table(spark, d, "documents", ["lang", "source", "text"]).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > 1000).alias("long"))


@query("g02_five_numbers", rf"SELECT avg(v) AS mean, {_pct(0.05)} AS p05, {_pct(0.25)} AS p25, {_pct(0.5)} AS p50, {_pct(0.75)} AS p75, {_pct(0.95)} AS p95, max(v)::DOUBLE AS max FROM (SELECT len(regexp_extract_all(text, '\S+')) AS v FROM documents)")
def g02(spark, d):
    return A.five_numbers(table(spark, d, "documents", ["text"]).select(T.word_count(F.col("text")).alias("v")), "v")


_PROFILE = NARR + r""", prof AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: regexp_full_match(x, 'X{2,}'))) AS markers FROM narratives)"""


@query("g03_conditional_counts", _PROFILE + " SELECT count(*) FILTER (markers >= 1) AS some, count(*) FILTER (markers = 0) AS none, count(*) FILTER (markers >= 5) AS many, avg((markers >= 1)::INT) AS share FROM prof")
def g03(spark, d):
    m = F.col("markers")
    return A.marker_profile(narratives(spark, d)).agg(F.count_if(m >= 1).alias("some"), F.count_if(m == 0).alias("none"), F.count_if(m >= 5).alias("many"), F.avg((m >= 1).cast("int")).alias("share"))


@query("g04_marker_share", _PROFILE + " SELECT 100.0::DOUBLE * sum(markers) / sum(greatest(words, 1)) AS all_docs, 100.0::DOUBLE * sum(markers) FILTER (markers > 0) / sum(greatest(words, 1)) FILTER (markers > 0) AS marked_docs FROM prof")
def g04(spark, d):
    m, w = F.col("markers"), F.greatest(F.col("words"), F.lit(1))
    share = lambda c: F.lit(100.0) * F.sum(F.when(c, m)) / F.sum(F.when(c, w))
    return A.marker_profile(narratives(spark, d)).agg(share(F.lit(True)).alias("all_docs"), share(m > 0).alias("marked_docs"))


@query("g05_histogram", _PROFILE + " SELECT markers::INT AS value, count(*) AS n FROM prof GROUP BY 1")
def g05(spark, d):
    return A.histogram(A.marker_profile(narratives(spark, d)), "markers")


_WORDS3 = rf"(SELECT list_filter({_LAST3}, lambda w: true) AS w FROM sided)"


@query("g06_ngrams", NARR + _CONTEXTS + f""", g AS (SELECT n, array_to_string(w[-n:], ' ') AS gram FROM {_WORDS3}, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n), c AS (SELECT n, gram, count(*) AS "count" FROM g WHERE gram <> '' GROUP BY 1, 2)
SELECT n::INT AS n, gram, "count" FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY "count" DESC, gram) AS r FROM c) WHERE r <= 120 AND (n > 1 OR gram NOT IN ('the', 'of'))""")
def g06(spark, d):
    before = F.col("before")
    return A.ngrams(marked_contexts(spark, d).select(T.left_words(before, F.length(before)).alias("w")), "w", most=120, stop=("the", "of"))


@query("g07_value_counts", "SELECT coalesce(quality::VARCHAR, '(missing)') AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def g07(spark, d):
    return A.value_counts(table(spark, d, "documents", ["doc_id"]).join(table(spark, d, "labels"), "doc_id", "left"), "quality")


@query("g08_shares", "SELECT lang, n, n::DOUBLE / sum(n) OVER () AS share FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def g08(spark, d):
    return A.with_share(A.histogram(table(spark, d, "documents", ["lang"]), "lang").withColumnRenamed("value", "lang"))


@query("g08_tier_rollup", f"SELECT tier, category, count(*) AS n FROM (" + NARR + _CONTEXTS + f"SELECT {_TIER_SQL} AS tier, category FROM (SELECT {_CATEGORY} AS category FROM sided)) WHERE tier IS NOT NULL GROUP BY ROLLUP (tier, category)")
def g08r(spark, d):
    kinds = classified(spark, d).select(tier(F.col("category")).alias("tier"), "category").where("tier is not null")
    return A.tier_rollup(kinds)


@query("g09_top_unresolved", NARR + _CONTEXTS + f"SELECT right(lhs, 24) AS before, substr(rhs, 1, 14) AS behind, count(*) AS n FROM sided WHERE {_CATEGORY} = 'UNKNOWN' GROUP BY 1, 2 ORDER BY n DESC, before, behind LIMIT 300")
def g09(spark, d):
    left = classified(spark, d).where("category = 'UNKNOWN'").groupBy(F.right("lhs", F.lit(24)).alias("before"), F.substring("rhs", 1, 14).alias("behind"))
    return left.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "before", "behind").limit(300)


@query("g10_survival", NARR + " UNION ALL ".join(f"SELECT '{n}' AS pattern, avg(regexp_matches(text, '{p}')::INT) AS share FROM narratives" for n, p in TIER3.items()))
def g10(spark, d):
    return A.survival(narratives(spark, d), {n: F.col("text").rlike(p) for n, p in TIER3.items()})


_TX = NARR.rstrip() + " "


@query("g11_value_uniqueness", "SELECT count(*) AS distinct_values, avg((n = 1)::INT) AS unique_share, avg(n) AS owners_per_value FROM (SELECT floor(o_totalprice / 500) AS v, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1)")
def g11(spark, d):
    return A.uniqueness(table(spark, d, "orders", ["o_totalprice", "o_custkey"]).select(F.floor(F.col("o_totalprice") / 500).alias("v"), "o_custkey"), ["v"], "o_custkey")


@query("g12_composite_uniqueness", _TX + "SELECT count(*) AS distinct_values, avg((n = 1)::INT) AS unique_share, avg(n) AS owners_per_value FROM (SELECT cents, day, merchant, count(DISTINCT customer_id) AS n FROM txns GROUP BY 1, 2, 3)")
def g12(spark, d):
    return A.uniqueness(transactions(spark, d), ["cents", "day", "merchant"], "customer_id")


SHARES = [64, 16, 4, 1]  # the whole population last


@query("g13_uniqueness_curve", _TX + f", sizes AS (SELECT (1 + max(customer_id)) // unnest({SHARES}) AS p FROM customers) SELECT p, count(*) AS distinct_values, avg((n = 1)::INT) AS unique_share, avg(n) AS owners_per_value FROM (SELECT p, cents, count(DISTINCT customer_id) AS n FROM txns, sizes WHERE customer_id < p GROUP BY 1, 2) GROUP BY p".replace("SELECT p, count(*)", "SELECT p AS population, count(*)"))
def g13(spark, d):
    everyone = customers(spark, d).agg(F.max("customer_id")).first()[0] + 1  # ids are ordinals
    return A.uniqueness_curve(transactions(spark, d), ["cents"], "customer_id", "customer_id", [everyone // k for k in SHARES])


@query("g14_injected_distribution", NARR + "SELECT v, m, count(*) AS n FROM narratives GROUP BY 1, 2")
def g14(spark, d):
    return narratives(spark, d).groupBy("v", "m").agg(F.count(F.lit(1)).alias("n"))


_EST = "(SELECT lang AS truth, CASE WHEN contains(lower(text), ' der ') THEN 'de' WHEN contains(lower(text), ' le ') THEN 'fr' WHEN contains(lower(text), ' the ') THEN 'en' ELSE 'UNKNOWN' END AS guess FROM documents)"


@query("g15_estimator_accuracy", f"""WITH p AS {_EST}, c AS (SELECT truth, guess, count(*) AS n FROM p GROUP BY 1, 2), w AS (SELECT truth, guess, row_number() OVER (PARTITION BY truth ORDER BY n DESC, guess) AS r FROM c WHERE guess <> truth AND guess <> 'UNKNOWN')
SELECT c.truth, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (c.guess = c.truth), 0)::BIGINT AS correct, coalesce(sum(n) FILTER (c.guess = 'UNKNOWN'), 0)::BIGINT AS unknown, any_value(w.guess) AS top_confusion FROM c LEFT JOIN w ON w.truth = c.truth AND w.r = 1 GROUP BY 1""")
def g15(spark, d):
    low = F.lower("text")
    guess = F.when(low.contains(" der "), "de").when(low.contains(" le "), "fr").when(low.contains(" the "), "en").otherwise("UNKNOWN")
    return A.estimator_accuracy(table(spark, d, "documents", ["lang", "text"]).select(F.col("lang").alias("truth"), guess.alias("guess")))


@query("g16_spread", "SELECT o_orderpriority, avg(o_custkey) AS mean, coalesce(stddev_samp(o_custkey), 0) AS stdev FROM orders GROUP BY 1")
def g16(spark, d):
    return A.spread(table(spark, d, "orders", ["o_orderpriority", "o_custkey"]), "o_orderpriority", "o_custkey")


@query("g18_stability", "SELECT o_orderstatus, min(o_totalprice) AS low, max(o_totalprice) AS high, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY 1")
def g18(spark, d):
    return A.stability(table(spark, d, "orders", ["o_orderstatus", "o_totalprice"]), "o_orderstatus", "o_totalprice")


@query("g19_majority_baseline", "SELECT lang, sum(n)::BIGINT AS gradable, max(n)::DOUBLE / sum(n) AS baseline FROM (SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def g19(spark, d):
    return utility.majority_baseline(table(spark, d, "documents", ["doc_id", "lang"]).join(table(spark, d, "labels"), "doc_id"), "quality", "lang")


@query("g20_reachability", "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'fr', 'de')")
def g20(spark, d):
    options = spark.createDataFrame([("en",), ("fr",), ("de",)], "lang string")
    return utility.unreachable(table(spark, d, "documents", ["doc_id", "lang"]), options, "lang").select("doc_id", "lang")


_ANSWERS = f"(SELECT doc_id, source, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS truth, CASE {_draw('ans', 'doc_id', 5)} WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN NULL WHEN 2 THEN 'en' ELSE upper(lang) END AS answer FROM documents)"


def answers(spark, d):
    k, lang = T.draw("ans", F.col("doc_id"), 5), F.col("lang")
    said = F.when(k == 0, "UNKNOWN").when(k == 2, "en").when(k > 2, F.upper(lang))
    return table(spark, d, "documents", ["doc_id", "source", "lang"]).select("doc_id", "source", F.when(F.col("doc_id") % 11 != 0, lang).alias("truth"), said.alias("answer"))


_GRADE = f"SELECT source, count(*) AS asked, count(*) FILTER (answer IS NOT NULL AND answer <> 'UNKNOWN') AS graded, count(*) FILTER (lower(answer) = truth) AS correct, count(*) FILTER (answer = 'UNKNOWN') AS unknown, (count(*) FILTER (lower(answer) = truth))::DOUBLE / greatest(count(*) FILTER (answer IS NOT NULL AND answer <> 'UNKNOWN'), 1) AS accuracy FROM {_ANSWERS} WHERE truth IS NOT NULL GROUP BY 1"


@query("g21_utility_accuracy", _GRADE)
def g21(spark, d):
    return utility.grade(answers(spark, d), "source")


@query("g22_utility_lost", f"WITH m AS ({_GRADE}) SELECT m.source, m.accuracy, r.accuracy - m.accuracy AS lost FROM m, (SELECT accuracy FROM m WHERE source = 'src0') r")
def g22(spark, d):
    return utility.lost_against(utility.grade(answers(spark, d), "source"), "source", "accuracy", "src0").select("source", "accuracy", "lost")


_YEARLY = "(SELECT o_orderpriority AS arm, year(o_orderdate)::INT AS year, avg(o_custkey) AS v FROM orders GROUP BY 1, 2)"


def yearly(spark, d):
    return table(spark, d, "orders", ["o_orderpriority", "o_orderdate", "o_custkey"]).groupBy(F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("year")).agg(F.avg("o_custkey").alias("v"))


@query("g23_transfer_drop", f"SELECT arm, first - last AS dropped, CASE WHEN first - last > 3 THEN 'better' WHEN first - last < -3 THEN 'worse' ELSE 'same' END AS verdict FROM (SELECT arm, arg_min(v, year) AS first, arg_max(v, year) AS last FROM {_YEARLY} GROUP BY 1)")
def g23(spark, d):
    change = utility.change(yearly(spark, d), "arm", "year", "v").withColumn("dropped", -F.col("gain"))
    return change.select("arm", (F.col("first") - F.col("last")).alias("dropped"), utility.verdict(F.col("first") - F.col("last")).alias("verdict"))


@query("g24_learning_gain", f"SELECT arm, arg_min(v, year) AS first, arg_max(v, year) AS last, arg_max(v, year) - arg_min(v, year) AS gain, arg_max(year, (v, -year)) AS best_at FROM {_YEARLY} GROUP BY 1")
def g24(spark, d):
    return utility.change(yearly(spark, d), "arm", "year", "v")


@query("g25_throughput", "SELECT source, docs, seconds, docs / seconds AS docs_per_s, 300000 / (docs / seconds) / 3600 AS hours_300k, 1000 / (docs / seconds) / 3600 * 0.25 AS cost_per_1k FROM (SELECT source, count(*)::DOUBLE AS docs, sum(n_chars) / 1000.0::DOUBLE AS seconds FROM documents GROUP BY 1)")
def g25(spark, d):
    runs = table(spark, d, "documents", ["source", "n_chars"]).groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("docs"), (F.sum("n_chars") / F.lit(1000.0)).alias("seconds"))
    return utility.throughput(runs, 0.25)


@query("g26_output_identity", f"SELECT count(*) AS n, avg((truth IS NOT DISTINCT FROM lower(answer))::INT) AS same_share FROM {_ANSWERS}")
def g26(spark, d):
    a = answers(spark, d)
    return utility.same_output(a.select("doc_id", "truth"), a.select("doc_id", F.lower("answer").alias("truth")), "doc_id", "truth")


# --- dedup, samples, splits

def _hash(seed: str, key: str) -> str:
    return f"md5('{seed}|' || {key})"


@query("d02_seeded_sample", f"SELECT doc_id FROM documents ORDER BY {_hash('20260806', 'doc_id')}, doc_id LIMIT 60")
def d02(spark, d):
    return ranking.sample(table(spark, d, "documents", ["doc_id"]), 60, "doc_id")


@query("d03_seeded_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {_hash('20260806', 'doc_id')}, doc_id) - 1 AS rn FROM documents")
def d03(spark, d):
    keyed = table(spark, d, "documents", ["doc_id"]).withColumn("h", F.conv(F.substring(ranking.hash_order("20260806", "doc_id"), 1, 15), 16, 10).cast("bigint"))
    return ranking.numbered(keyed, "h", "doc_id").select("doc_id", "rn")


@query("d04_positional_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 0.7 * count(*) OVER () THEN 'train' ELSE 'eval' END AS split FROM documents")
def d04(spark, d):
    ids = table(spark, d, "documents", ["doc_id"])
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    return ranking.numbered(ids, "doc_id").crossJoin(F.broadcast(n)).select("doc_id", F.when(F.col("rn") + 1 <= F.lit(0.7) * F.col("n"), "train").otherwise("eval").alias("split"))


_SPLIT = f"(SELECT doc_id, md5(text) AS head, CASE WHEN {_draw('split', 'doc_id', 10000)} < 7000 THEN 'train' ELSE 'eval' END AS split FROM documents)"


def split_heads(spark, d):
    return ranking.hash_split(table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("head")), "doc_id", 0.7)


@query("d05_source_split_no_collisions", f"WITH s AS {_SPLIT} SELECT doc_id, head, split FROM s WHERE split = 'train' OR head NOT IN (SELECT head FROM s WHERE split = 'train')")
def d05(spark, d):
    return ranking.without_collisions(split_heads(spark, d), "head").select("doc_id", "head", "split")


@query("d06_pool_split", "SELECT p_name, CASE WHEN row_number() OVER (ORDER BY p_name) <= 0.7 * count(*) OVER () THEN 'train' ELSE 'eval' END AS split FROM (SELECT DISTINCT p_name FROM part)")
def d06(spark, d):
    pool = table(spark, d, "part", ["p_name"]).distinct()
    n = pool.agg(F.count(F.lit(1)).alias("n"))
    placed = pool.withColumn("rn", F.row_number().over(Window.orderBy("p_name")) - 1) if pool.limit(100_001).count() <= 100_000 else ranking.numbered(pool, "p_name")
    return placed.crossJoin(F.broadcast(n)).select("p_name", F.when(F.col("rn") + 1 <= F.lit(0.7) * F.col("n"), "train").otherwise("eval").alias("split"))


@query("d07_template_split", "SELECT p_brand, p_name, CASE WHEN r <= 4 THEN 'train' ELSE 'eval' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS r FROM (SELECT DISTINCT p_brand, p_name FROM part)) WHERE r <= 6")
def d07(spark, d):
    ranked = ranking.top_per(table(spark, d, "part", ["p_brand", "p_name"]).distinct(), ["p_brand"], ["p_name"], 6)
    return ranked.select("p_brand", "p_name", F.when(F.col("rank") <= 4, "train").otherwise("eval").alias("split"))


@query("d08_set_overlap", f"WITH s AS {_SPLIT}, a AS (SELECT DISTINCT head FROM s WHERE split = 'train'), b AS (SELECT DISTINCT head FROM s WHERE split = 'eval') SELECT (SELECT count(*) FROM a WHERE head IN (FROM b)) AS shared, (SELECT count(*) FROM a WHERE head NOT IN (FROM b)) AS only_a, (SELECT count(*) FROM b WHERE head NOT IN (FROM a)) AS only_b")
def d08(spark, d):
    s = split_heads(spark, d)
    return utility.disjoint(s.where("split = 'train'"), s.where("split = 'eval'"), "head")


@query("d10_usable_categories", f"WITH s AS {_SPLIT} SELECT substr(head, 1, 1) AS category FROM s GROUP BY 1 HAVING count(*) FILTER (split = 'train') >= 20 AND count(*) FILTER (split = 'eval') >= 5")
def d10(spark, d):
    n = split_heads(spark, d).groupBy(F.substring("head", 1, 1).alias("category")).agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "eval").alias("b"))
    return n.where("a >= 20 and b >= 5").select("category")


@query("d11_source_precedence", "SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'site' END, CASE WHEN toxic = 1 THEN 'mined' END, 'authored') AS origin FROM documents LEFT JOIN labels USING (doc_id)")
def d11(spark, d):
    both = table(spark, d, "documents", ["doc_id"]).join(table(spark, d, "labels"), "doc_id", "left")
    return both.select("doc_id", F.coalesce(F.when(F.col("quality") == 1, "site"), F.when(F.col("toxic") == 1, "mined"), F.lit("authored")).alias("origin"))


@query("d12_one_entity_each", "SELECT doc_id, w[doc_id % len(w) + 1] AS entity FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS w FROM documents) WHERE len(w) > 0")
def d12(spark, d):
    w = table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", T.find_all(F.col("text"), "[A-Z][a-z]+").alias("w")).where("size(w) > 0")
    return w.select("doc_id", F.element_at("w", (F.pmod(F.col("doc_id"), F.size("w")) + 1).cast("int")).alias("entity"))


# --- joins

@query("j01_group_to_lists", _TX + "SELECT customer_id, count(*) AS n, min(txn_id) AS first, sum(cents)::BIGINT AS cents FROM txns GROUP BY 1")
def j01(spark, d):
    return transactions(spark, d).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.min("txn_id").alias("first"), F.sum("cents").alias("cents"))


@query("j02_round_robin", "SELECT doc_id, c_custkey FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % (SELECT count(*) FROM customer) AS slot FROM documents) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS slot FROM customer) USING (slot)")
def j02(spark, d):
    return ranking.round_robin(table(spark, d, "documents", ["doc_id"]), "doc_id", table(spark, d, "customer", ["c_custkey"]), "c_custkey")


@query("j03_denormalise", "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def j03(spark, d):
    part, supplier = table(spark, d, "part", ["p_partkey", "p_name"]), table(spark, d, "supplier", ["s_suppkey", "s_name"])
    lines = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return lines.join(linkage.small(part), F.col("p_partkey") == F.col("l_partkey")).join(linkage.small(supplier), F.col("s_suppkey") == F.col("l_suppkey")).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("j04_amount_band", "SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM (SELECT * FROM orders WHERE o_orderkey % 50 = 0) a JOIN orders b ON abs(round(a.o_totalprice * 100)::BIGINT - round(b.o_totalprice * 100)::BIGINT) <= 5000")
def j04(spark, d):
    cents = table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    asked = cents.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("left_key"), F.col("cents").alias("asked"))
    return linkage.band_join(asked, cents, "asked", "cents", 5000).select("left_key", F.col("o_orderkey").alias("right_key"))


@query("j05_date_band", NARR + "SELECT doc_id, txns.txn_id FROM narratives JOIN txns USING (customer_id) WHERE abs(date_diff('day', narratives.day, txns.day)) <= 90")
def j05(spark, d):
    n = narratives(spark, d).select("doc_id", "customer_id", F.col("day").alias("told_day"))
    return n.join(transactions(spark, d), "customer_id").where(F.abs(F.datediff("told_day", "day")) <= 90).select("doc_id", "txn_id")


@query("j07_merchant_postings", NARR + ", asked AS (SELECT doc_id, merchant FROM (SELECT DISTINCT doc_id, lower(told) AS told FROM narratives) JOIN (SELECT DISTINCT merchant FROM txns) ON contains(told, merchant)) SELECT doc_id, count(DISTINCT customer_id) AS customers FROM asked JOIN (SELECT DISTINCT merchant, customer_id FROM txns) USING (merchant) GROUP BY 1")
def j07(spark, d):
    pairs = transactions(spark, d).select("merchant", "customer_id").distinct().persist(StorageLevel.DISK_ONLY)  # read three times
    known = pairs.select(F.col("merchant").alias("name"))
    found = linkage.evidence(narratives(spark, d).select("doc_id", F.col("told").alias("text")), known, known.limit(0), "Customer#[0-9]{9}")
    return linkage.customers_of(found.select("doc_id", "merchants"), pairs)


_KEYED = lambda source, name: rf"(SELECT doc_id AS {name}, i, trim(regexp_replace(lower(t), '[ \t\n\r\f]+', ' ', 'g')) AS s FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_SENTENCE_SQL} AS l FROM {source})))"


@query("j14_sentence_sources", NARR + f""", known AS (SELECT md5(s) AS h, min(source_id) AS source_id FROM {_KEYED('documents', 'source_id')} WHERE length(s) >= 60 GROUP BY 1),
 asked AS (SELECT doc_id, md5(s) AS h, length(s) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY length(s) DESC, i) AS probe FROM {_KEYED('narratives', 'doc_id')})
 SELECT doc_id, arg_min(source_id, probe) AS source_id FROM asked JOIN known USING (h) WHERE probe <= 6 AND n >= 60 GROUP BY 1""")
def j14(spark, d):
    return utility.sentence_sources(narratives(spark, d).select("doc_id", "text"), table(spark, d, "documents", ["doc_id", "text"]))


@query("j15_metadata_join", "SELECT d.doc_id, lang, source, quality, toxic FROM documents d JOIN labels USING (doc_id)")
def j15(spark, d):
    return table(spark, d, "documents", ["doc_id", "lang", "source"]).join(table(spark, d, "labels", ["doc_id", "quality", "toxic"]), "doc_id")


@query("j16_semi_anti", "SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS labelled, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled FROM documents")
def j16(spark, d):
    docs, labels = table(spark, d, "documents", ["doc_id"]), table(spark, d, "labels", ["doc_id"])
    counts = lambda how, name: docs.join(labels, "doc_id", how).agg(F.count(F.lit(1)).alias(name))
    return counts("left_semi", "labelled").crossJoin(counts("left_anti", "unlabelled"))


@query("j18_linkage_check", _TX + "SELECT count(*) AS pairs, count(*) FILTER (n = 1) AS resolved, avg((n = 1)::INT) AS share FROM (SELECT cents, day, count(DISTINCT customer_id) AS n FROM txns GROUP BY 1, 2)")
def j18(spark, d):
    owners = transactions(spark, d).select("cents", "day", "customer_id").distinct().groupBy("cents", "day").agg(F.count(F.lit(1)).alias("n"))
    return owners.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("n") == 1).alias("resolved"), F.avg((F.col("n") == 1).cast("int")).alias("share"))


# --- ranks

@query("w01_total_sort", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS rn FROM part")
def w01(spark, d):
    priced = table(spark, d, "part", ["p_partkey", "p_retailprice"]).withColumn("down", -F.col("p_retailprice"))
    return ranking.numbered(priced, "down", "p_partkey").select("p_partkey", "rn")


@query("w02_head", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def w02(spark, d):
    return table(spark, d, "documents", ["doc_id", "lang"]).orderBy("doc_id").limit(25)


@query("w03_top_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def w03(spark, d):
    return ranking.top_per(table(spark, d, "documents", ["source", "doc_id", "n_chars"]), ["source"], [F.desc("n_chars"), "doc_id"], 3).select("source", "doc_id")


@query("w04_unique_top", "SELECT user_id, event_type FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS top, count(*) OVER (PARTITION BY user_id, n) AS ties FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE n = top AND ties = 1")
def w04(spark, d):
    n = table(spark, d, "events", ["user_id", "event_type"]).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    ranked = n.withColumn("top", F.max("n").over(Window.partitionBy("user_id"))).withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy("user_id", "n")))
    return ranked.where("n = top and ties = 1").select("user_id", "event_type")


# --- generation

@query("i02_weighted_draw", f"SELECT category, count(*) AS n FROM (SELECT CASE WHEN u < 0.5 THEN 'A' WHEN u < 0.8 THEN 'B' ELSE 'C' END AS category FROM (SELECT {_draw('w', 'doc_id', 4294967296)} / 4294967296.0::DOUBLE AS u FROM documents)) GROUP BY 1")
def i02(spark, d):
    drawn = generate.weighted_category({"A": 0.5, "B": 0.3, "C": 0.2}, "w", F.col("doc_id"))
    return table(spark, d, "documents", ["doc_id"]).groupBy(drawn.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("i03_bernoulli_overlay", f"SELECT doc_id, array_to_string(list_concat(['PERSON'], list_filter([CASE WHEN {_draw('o-DATE', 'doc_id', 4294967296)} / 4294967296.0::DOUBLE < 0.4 THEN 'DATE' END, CASE WHEN {_draw('o-AMOUNT', 'doc_id', 4294967296)} / 4294967296.0::DOUBLE < 0.7 THEN 'AMOUNT' END], lambda x: x IS NOT NULL)), ',') AS categories FROM documents")
def i03(spark, d):
    drawn = generate.overlay(F.array(F.lit("PERSON"), F.lit("DATE")), {"DATE": 0.4, "AMOUNT": 0.7}, "o", F.col("doc_id"))
    return table(spark, d, "documents", ["doc_id"]).select("doc_id", F.array_join(drawn, ",").alias("categories"))


@query("i05_splice", NARR + "SELECT doc_id, 'Paid by ' || name || '. ' || told || CASE WHEN told LIKE '%. %' THEN '' ELSE '' END || ' Order no ' || txn_id || '.' AS text, 8 AS start, (8 + length(name))::INT AS \"end\", 2 AS placed, 1 AS n_spans, name AS value FROM narratives WHERE NOT contains(told, '. ')")
def i05(spark, d):
    n = narratives(spark, d).where(~F.col("told").contains(". "))
    item = lambda lead, value, category: F.struct(F.lit(lead).alias("lead"), value.cast("string").alias("value"), F.lit(category).cast("string").alias("category"))
    put = n.select("doc_id", generate.splice(F.col("told"), F.array(item("Paid by ", F.col("name"), "PERSON"), item("Order no ", F.col("txn_id"), None))).alias("r"))
    first = F.col("r.spans")[0]
    return put.select("doc_id", "r.text", first["start"].alias("start"), first["end"].alias("end"), F.col("r.placed").alias("placed"), F.size("r.spans").alias("n_spans"), F.substring(F.col("r.text"), first["start"] + 1, first["end"] - first["start"]).alias("value"))


def _nested(n: int) -> str:
    return f"(SELECT i, {_draw('txns', 'i', 49)} + 12 AS n_txns, {_draw('city', 'i', 6)} AS city, CASE WHEN {_draw('cards', 'i', 100)} < 18 THEN 2 ELSE 1 END AS cards FROM (SELECT unnest(range({n})) AS i))"


@query("i01_population", f"SELECT count(*) AS customers, sum(n_txns)::BIGINT AS txns, sum(cards)::BIGINT AS cards, count(DISTINCT city) AS cities FROM {_nested(800)}")
def i01(spark, d):
    people, shops = generate.customers(spark, 800), generate.merchants(spark)
    txns = generate.transactions(people, shops, 400).agg(F.count(F.lit(1)).alias("txns"))
    return people.agg(F.count(F.lit(1)).alias("customers"), F.count_distinct("city").alias("cities")).crossJoin(txns).crossJoin(generate.cards(people).agg(F.count(F.lit(1)).alias("cards")))


@query("i10_nested_populations", f"SELECT sum(n_txns)::BIGINT AS txns, sum(n_txns)::BIGINT AS unchanged FROM {_nested(200)}")
def i10(spark, d):
    shops = generate.merchants(spark)
    small = generate.transactions(generate.customers(spark, 200), shops, 400)
    large = generate.transactions(generate.customers(spark, 500), shops, 400)
    return small.agg(F.count(F.lit(1)).alias("txns")).crossJoin(small.intersectAll(large).agg(F.count(F.lit(1)).alias("unchanged")))


# --- the attack

CITY_NAMES = "(SELECT DISTINCT lower(n_name) AS name FROM nation)"
_CONFIGS = ", ".join(f"({i}, '{n}', {a}, {y}, {m}, {c}, {cents}, {days})" for i, n, a, y, m, c, cents, days in linkage.configuration_list())
_WIDEST = max(c[6] for c in linkage.configuration_list())

ATTACK = NARR + rf""", names AS {CITY_NAMES}, words AS (SELECT DISTINCT merchant AS name FROM txns),
 ev AS (SELECT doc_id, customer_id AS true_id, text,
   list_transform(regexp_extract_all(text, '\$\s?([0-9][0-9,]*\.[0-9]{{2}})', 1), lambda a: regexp_replace(a, '[,.]', '', 'g')::BIGINT) AS amounts,
   list_transform({dates_sql()}, lambda x: x::DATE) AS dates,
   regexp_extract_all(text, 'Customer#[0-9]{{9}}') AS names FROM narratives),
 ev2 AS (SELECT ev.*, coalesce((SELECT list(name ORDER BY name) FROM words WHERE contains(lower(ev.text), name)), []) AS merchants, coalesce((SELECT list(name ORDER BY name) FROM names WHERE contains(lower(ev.text), name)), []) AS cities FROM ev),
 cfg AS (SELECT * FROM (VALUES {_CONFIGS}) AS t(config_id, fields, ua, ud, um, uc, cents_tol, day_tol)),
 asked AS (SELECT doc_id, unnest(list_distinct(amounts[1:6])) AS amount FROM ev2),
 by_amount AS (SELECT a.doc_id, t.txn_id, min(abs(a.amount - t.cents)) AS off FROM asked a JOIN txns t ON t.cents BETWEEN a.amount - {_WIDEST} AND a.amount + {_WIDEST} GROUP BY 1, 2),
 by_merchant AS (SELECT doc_id, t.txn_id FROM (SELECT doc_id, unnest(merchants[1:6]) AS merchant FROM ev2) JOIN txns t USING (merchant)),
 near_ AS (SELECT coalesce(a.doc_id, m.doc_id) AS doc_id, coalesce(a.txn_id, m.txn_id) AS txn_id, a.off, m.doc_id IS NOT NULL AS by_m FROM by_amount a FULL JOIN by_merchant m ON a.doc_id = m.doc_id AND a.txn_id = m.txn_id),
 told_ AS (SELECT n.*, t.customer_id, len(e.amounts) > 0 AS has_a, len(e.merchants) = 0 OR list_contains(e.merchants, t.merchant) AS ok_m, CASE WHEN len(e.dates) > 0 THEN list_min(list_transform(e.dates[1:6], lambda x: abs(date_diff('day', x, t.day)))) END AS days_off
   FROM near_ n JOIN ev2 e USING (doc_id) JOIN txns t USING (txn_id)),
 rows_ AS (
   SELECT cfg.config_id, e.doc_id, e.txn_id, e.customer_id FROM told_ e, cfg
   WHERE ((cfg.ua AND e.has_a AND e.off <= cfg.cents_tol AND (NOT cfg.um OR e.ok_m)) OR (cfg.um AND NOT (cfg.ua AND e.has_a) AND e.by_m))
     AND (NOT cfg.ud OR e.days_off IS NULL OR e.days_off <= cfg.day_tol)),
 hits AS (SELECT config_id, doc_id, customer_id, count(*) AS hits FROM rows_ GROUP BY 1, 2, 3),
 named AS (SELECT DISTINCT cfg.config_id, e.doc_id, c.customer_id FROM ev2 e, cfg, customers c WHERE list_contains(e.names[1:4], c.name)),
 both_ AS (SELECT coalesce(h.config_id, n.config_id) AS config_id, coalesce(h.doc_id, n.doc_id) AS doc_id, coalesce(h.customer_id, n.customer_id) AS customer_id, h.hits, n.doc_id IS NOT NULL AS named FROM hits h FULL JOIN named n ON h.config_id = n.config_id AND h.doc_id = n.doc_id AND h.customer_id = n.customer_id),
 flagged AS (SELECT *, bool_or(named) OVER w AS any_named, bool_or(named AND hits IS NOT NULL) OVER w AS any_both FROM both_ WINDOW w AS (PARTITION BY config_id, doc_id)),
 kept AS (SELECT config_id, doc_id, customer_id, coalesce(hits, 0) + named::INT AS hits FROM flagged WHERE CASE WHEN NOT any_named THEN hits IS NOT NULL WHEN any_both THEN named AND hits IS NOT NULL ELSE named END),
 placed AS (SELECT k.*, cfg.uc AND list_contains(e.cities, c.city) AS inside FROM kept k JOIN customers c USING (customer_id) JOIN ev2 e USING (doc_id) JOIN cfg USING (config_id)),
 cands AS (SELECT * FROM (SELECT *, bool_or(inside) OVER (PARTITION BY config_id, doc_id) AS any_inside FROM placed) WHERE inside OR NOT any_inside),
 topped AS (SELECT *, max(hits) OVER (PARTITION BY config_id, doc_id) AS top FROM cands),
 per AS (SELECT config_id, doc_id, count(*) AS n, bool_or(customer_id = true_id) AS found, count(*) FILTER (hits = top) AS holders, bool_or(customer_id = true_id AND hits = top) AS top_true FROM topped JOIN (SELECT doc_id, true_id FROM ev) USING (doc_id) GROUP BY 1, 2),
 verd AS (SELECT cfg.config_id, cfg.fields, cfg.cents_tol AS cents, cfg.day_tol AS days, (coalesce(found AND n = 1, false))::INT AS u, (coalesce(found AND n < 5, false))::INT AS k, (coalesce(holders = 1 AND top_true, false))::INT AS r, (coalesce(n = 1 AND NOT found, false))::INT AS fp FROM ev CROSS JOIN cfg LEFT JOIN per ON per.doc_id = ev.doc_id AND per.config_id = cfg.config_id),
 metrics AS (SELECT fields, cents, days, count(*) AS docs, avg(u) AS u_rate, avg(k) AS k_rate, avg(r) AS r_rate, avg(fp) AS fp_rate FROM verd GROUP BY 1, 2, 3)
"""


def attack_metrics(spark, d, docs=None):
    txns, people = transactions(spark, d), customers(spark, d)
    docs = narratives(spark, d).select("doc_id", "text", "customer_id") if docs is None else docs
    found = linkage.evidence(docs, txns.select(F.col("merchant").alias("name")), people.select(F.col("city").alias("name")), "Customer#[0-9]{9}")
    return linkage.sweep(docs, found, txns, people)


@query("j12_attack_sweep", ATTACK + "SELECT * FROM metrics")
def j12(spark, d):
    return attack_metrics(spark, d)


@query("j13_selected_config", ATTACK + "SELECT * FROM metrics ORDER BY CASE WHEN fp_rate <= 0.05 THEN 0 ELSE 1 END, CASE WHEN fp_rate <= 0.05 THEN -u_rate ELSE fp_rate END, cents, days, length(fields), fields LIMIT 1")
def j13(spark, d):
    return linkage.select_config(attack_metrics(spark, d))


@query("p14_fp_ceiling", ATTACK + "SELECT fields, cents, days FROM metrics WHERE fp_rate <= 0.05 OR NOT EXISTS (SELECT 1 FROM metrics WHERE fp_rate <= 0.05) AND fp_rate = (SELECT min(fp_rate) FROM metrics)")
def p14(spark, d):
    m = attack_metrics(spark, d)
    least = m.agg(F.min("fp_rate").alias("least"))
    return m.crossJoin(F.broadcast(least)).where((F.col("fp_rate") <= linkage.FP_CEILING) | ((F.col("least") > linkage.FP_CEILING) & (F.col("fp_rate") == F.col("least")))).select("fields", "cents", "days")


@query("m4_raw_against_redacted", ATTACK + ", m2 AS (SELECT max(u_rate) AS raw_u, max(k_rate) AS raw_k FROM metrics) SELECT raw_u, raw_k FROM m2")
def m4(spark, d):
    return attack_metrics(spark, d).agg(F.max("u_rate").alias("raw_u"), F.max("k_rate").alias("raw_k"))
