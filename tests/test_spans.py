"""Span algebra against plain Python."""

import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from umbra.functions import detectors, rules, spans, tags
from umbra.functions import text as T
from umbra.plans import span_queries

KIND = "array<struct<start:int,end:int,category:string>>"


def plain_merge(items):
    out = []
    for s, e, c in sorted(items):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2])
        else:
            out.append((s, e, c))
    return out


def plain_match(t, g):
    over = max(0, t[0] - g[0]) + max(0, g[1] - t[1])
    return t[0] < g[1] and g[0] < t[1] and 2 * over <= max(t[1] - t[0], 1)


def plain_greedy(truths, guesses):
    guesses, used, pairs = guesses, set(), []
    for t in truths:
        for k, g in enumerate(guesses):
            if k not in used and plain_match(t, g):
                used.add(k)
                pairs.append((t, k))
                break
    return pairs


def drawn(seed, n=200):
    rnd = random.Random(seed)
    one = lambda: [(s := rnd.randint(0, 40), s + rnd.randint(1, 15), rnd.choice("AB")) for _ in range(rnd.randint(0, 5))]
    return [(k, one(), one()) for k in range(n)]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = drawn(1)
    return rows, spark.createDataFrame(rows, f"doc_id int, truths {KIND}, guesses {KIND}")


def as_tuples(items):
    return [(r["start"], r["end"], r["category"]) for r in items]


def test_merge(pairs):
    rows, df = pairs
    got = {r["doc_id"]: as_tuples(r["m"]) for r in df.select("doc_id", spans.merge(F.col("guesses")).alias("m")).collect()}
    assert got == {k: plain_merge(g) for k, _, g in rows}


def test_merge_rows_is_merge(pairs):
    rows, df = pairs
    flat = df.select("doc_id", F.inline("guesses"))
    got = sorted((r["doc_id"], r["start"], r["end"], r["category"]) for r in spans.merge_rows(flat).collect())
    assert got == sorted((k, *m) for k, _, g in rows for m in plain_merge(g))


def test_greedy(pairs):
    rows, df = pairs
    got = {r["doc_id"]: [(tuple(p["truth"]), p["guess"]) for p in r["p"]] for r in df.select("doc_id", spans.greedy_pairs(F.col("truths"), F.col("guesses")).alias("p")).collect()}
    assert got == {k: plain_greedy(t, g) for k, t, g in rows}


def test_coverage(pairs):
    rows, df = pairs
    chars = lambda items: {k for s, e, _ in items for k in range(s, e)}
    got = df.select("doc_id", spans.covered(F.col("truths")).alias("a"), spans.shared(F.col("truths"), F.col("guesses")).alias("b")).collect()
    assert {r["doc_id"]: (r["a"], r["b"]) for r in got} == {k: (len(chars(t)), len(chars(t) & chars(g))) for k, t, g in rows}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aXé😀 /1@.-", max_size=30), min_size=1, max_size=20))
def test_locate_is_finditer(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for pattern in (T.MARKER, T.MERGED_MARKER, "[a1]+@"):
        got = {r["k"]: [(s["start"], s["end"]) for s in r["s"]] for r in df.select("k", spans.locate(F.col("t"), pattern).alias("s")).collect()}
        assert got == {k: [m.span() for m in re.finditer(pattern, t)] for k, t in enumerate(texts)}


def test_replace_and_tag(spark):
    df = spark.createDataFrame([("x 1 é22 y", [(2, 3, "A"), (5, 7, "B")]), ("", []), ("abc", [(0, 3, "A"), (1, 2, "B")])], f"t string, s {KIND}")
    got = df.select(spans.replace_spans(F.col("t"), F.col("s")).alias("r"), spans.tag_spans(F.col("t"), F.col("s")).alias("g")).collect()
    assert [tuple(r) for r in got] == [("x [REDACTED] é[REDACTED] y", "x <A>1</A> é<B>22</B> y"), ("", ""), ("[REDACTED]", "<A>abc</A>")]


def test_fill_markers_offsets(spark):
    df = spark.createDataFrame([("XXXX of XXXX!", ["Ada", "Bo"]), ("none", ["Ada"]), ("XXXX XXXX XXXX", ["é"])], "t string, v array<string>")
    for r in df.select(spans.fill_markers(F.col("t"), r"\bX{4}\b", F.col("v")).alias("r")).collect():
        for s in r["r"]["spans"]:
            assert r["r"]["text"][s["start"] : s["end"]] in ("Ada", "Bo", "é")


def test_tags():
    assert tags.parse("a <PERSON>Ada</PERSON> <B>b</B> <DATE></DATE></DATE>") == ("a Ada <B>b</B> ", [(2, 5, "PERSON")])
    assert tags.recover("I am Ada Lovelace of London and so on and on", "I am <PERSON>Ada Lovelace</PERSON> of London and so on and on") == ([(5, 17, "PERSON")], 0, False)
    assert tags.recover("I am Ada", "")[2]
    text = "word " * 60 + "Ada"
    found, missing, refused = tags.recover(text, text.replace("word Ada", "word  <PERSON>Ada</PERSON>"))
    assert not refused and found == [(300, 303, "PERSON")]


def test_model_adapter_keeps_rows(spark):
    df = spark.createDataFrame([(k, "x" * (k % 7) + " 123-45-6789") for k in range(50)] + [(50, None)], "doc_id int, text string")
    got = detectors.by_model(df, detectors.pattern_detector({"GOV_ID": detectors.STRUCTURED["GOV_ID"]}), batch=8).collect()
    assert {r["doc_id"]: as_tuples(r["spans"]) for r in got} == {k: [(k % 7 + 1, k % 7 + 12, "GOV_ID")] for k in range(50)} | {50: []}


def test_missing_packages_are_named_when_used():
    with pytest.raises(ImportError):
        detectors.presidio_detector({})()


def test_rule_order(spark):
    df = spark.createDataFrame([("name is ", "XXXX", " percent"), ("name is ", "XXXX", " called"), ("on ", "XX/XX/2023", ""), ("x ", "XXXX", "")], "l string, m string, r string")
    got = [r["c"] for r in df.select(rules.classify(rules.CONTEXT_RULES, F.col("l"), F.col("m"), F.col("r"))[0].alias("c")).collect()]
    assert got == ["NOT_PII", "PERSON", "DATE", "UNKNOWN"]


def test_dates_skip_the_impossible(spark):
    df = spark.createDataFrame([("on 2/30/2024, 1/2/2024 and 3/4/24",)], "t string")
    assert [str(x) for x in df.select(T.dates(F.col("t")).alias("d")).first()["d"]] == ["2024-01-02", "2024-03-04"]


def test_neighbours_are_redacted_and_counted_apart(spark, monkeypatch):
    texts = ["1" * 16 + "2" * 16, "id 123-45-6789", "4111 1111 1111 1111123-45-6789", "123-45-6789 4111-1111-1111-1111", "3" * 40, "none", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    monkeypatch.setattr(span_queries, "narratives", lambda spark, d: docs)
    mark = "[REDACTED]"
    redacted = [mark * 2, f"id {mark}", mark * 2, f"123-45-{mark}-1111", mark * 2 + "3" * 8, "none", ""]
    got = {r["doc_id"]: r["digest"] for r in span_queries.a08(spark, "").collect()}
    assert got == {k: hashlib.md5(t.encode()).hexdigest() for k, t in enumerate(redacted)}
    assert [r["n"] for r in span_queries.u01(spark, "").orderBy("doc_id").collect()] == [2, 1, 1, 2, 2, 0, 0]
