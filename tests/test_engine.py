"""Sources, streaming, linkage, generation, and every query against DuckDB."""

import datetime
import importlib
import os
import random
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from umbra.operators import aggregates, generate, linkage, ranking, utility
from umbra.plans import registry
from umbra.sources import io
from umbra.streaming import gate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as con:
        con.execute("SET TimeZone='UTC'")
        for name in TABLES:
            con.execute(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
        yield con


def plain(df: pd.DataFrame) -> list[tuple]:
    def show(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if type(v).__name__.startswith("bool"):
            return str(bool(v))
        if type(v).__name__.startswith("float"):
            return f"{v:.9g}"
        return str(v.tolist()) if hasattr(v, "tolist") else str(v)

    return sorted(tuple(show(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query_is_its_sql(spark, db, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), db.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_flagship(spark):
    got = registry.flagship(spark, SF).toPandas()
    assert set(got.method) == {"raw", "patterns"}
    raw, masked = (got[got.method == m].set_index(["fields", "cents", "days"]) for m in ("raw", "patterns"))
    assert raw.u_rate.max() > 0 and (masked.u_rate <= raw.u_rate.max()).all() and masked.u_rate.mean() < raw.u_rate.mean()
    assert (raw.u_rate <= raw.k_rate).all() and (raw.u_rate <= raw.r_rate).all()


def test_band_join_is_the_band(spark):
    left = spark.createDataFrame([(k, (k * 37) % 211 - 50) for k in range(120)], "a int, x int")
    right = spark.createDataFrame([(k, (k * 53) % 199 - 40) for k in range(120)], "b int, y int")
    rows, other = left.collect(), right.collect()
    for tolerance in (0, 1, 5, 25):
        got = sorted((r["a"], r["b"]) for r in linkage.band_join(left, right, "x", "y", tolerance).collect())
        assert got == sorted((p["a"], q["b"]) for p in rows for q in other if abs(p["x"] - q["y"]) <= tolerance)


def test_band_join_has_no_nested_loop(spark):
    left, right = spark.range(1000).selectExpr("id a", "id * 3 x"), spark.range(1000).selectExpr("id b", "id * 5 y")
    plan = linkage.band_join(left, right, "x", "y", 7)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def attack(spark, docs, fields, cents=0, days=0):
    txns = spark.createDataFrame(
        [(1, 10, 5000, "old shop"), (2, 11, 5000, "new shop"), (3, 12, 7000, "old shop"), (4, 12, 9000, "new shop"), (5, 13, 5100, "far shop")], "txn_id int, customer_id int, cents bigint, merchant string"
    ).withColumn("day", F.lit(datetime.date(2024, 1, 2)))
    people = spark.createDataFrame([(10, "Ada Abbe", "rome"), (11, "Bo Brook", "oslo"), (12, "Cy Cole", "rome"), (13, "Di Dunn", "bern")], "customer_id int, name string, city string")
    found = linkage.evidence(docs, txns.select(F.col("merchant").alias("name")), people.select(F.col("city").alias("name")), "[A-Z][a-z]+ [A-Z][a-z]+")
    listed = linkage.configuration_list({"f": fields}, [(cents, days)])
    configs = linkage.configurations(spark, listed)
    hits = linkage.candidates(found, txns, people, listed)
    got = {}
    for r in hits.collect():
        got.setdefault(r["doc_id"], {})[r["customer_id"]] = r["hits"]
    flags = {r["doc_id"]: (r["u"], r["k"], r["r"], r["fp"]) for r in linkage.verdicts(docs, hits, configs).collect()}
    return got, flags


def test_evidence_tree(spark):
    docs = spark.createDataFrame(
        [
            (1, "paid $50.00", 10),  # two customers share the amount
            (2, "paid $50.00 at old shop", 10),
            (3, "something on 1/2/2024", 10),  # a date alone opens nothing
            (4, "at old shop", 12),  # merchants open where no amount is
            (5, "paid $70.00, I am Ada Abbe", 12),  # a name that disagrees replaces the hits
            (6, "paid $50.00, I am Ada Abbe", 10),  # one that agrees narrows them
            (7, "paid $50.00 in oslo", 11),
            (8, "paid $50.00 in bern", 10),  # a city that would empty the candidates is ignored
            (9, "paid $70.00", 10),  # sure and wrong
            (10, "nothing", 10),
        ],
        "doc_id int, text string, customer_id int",
    )
    got, flags = attack(spark, docs, ["amount", "date", "merchant", "city"])
    assert got == {1: {10: 1, 11: 1}, 2: {10: 1}, 4: {10: 1, 12: 1}, 5: {10: 1}, 6: {10: 2}, 7: {11: 1}, 8: {10: 1, 11: 1}, 9: {12: 1}}
    assert flags[1] == (0, 1, 0, 0) and flags[2] == (1, 1, 1, 0) and flags[9] == (0, 0, 0, 1) and flags[10] == flags[3] == (0, 0, 0, 0)
    wide, _ = attack(spark, docs, ["amount"], cents=100)
    assert set(wide[1]) == {10, 11, 13}


def test_selection_rule(spark):
    kind = "fields string, cents int, days int, u_rate double, fp_rate double"
    rows = [("a", 0, 0, 0.2, 0.01), ("b", 0, 0, 0.9, 0.2), ("a+b", 0, 0, 0.2, 0.01)]
    assert linkage.select_config(spark.createDataFrame(rows, kind)).first()["fields"] == "a"
    assert linkage.select_config(spark.createDataFrame([("a", 0, 0, 0.2, 0.3), ("b", 0, 0, 0.1, 0.2)], kind)).first()["fields"] == "b"


def test_numbered(spark):
    df = spark.createDataFrame([((k * 7919) % 1009, k) for k in range(700)] + [(5, 1000 + k) for k in range(200)], "a int, b int")
    got = ranking.numbered(df, "a", "b").orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(900)) and [(r["a"], r["b"]) for r in got] == sorted((r["a"], r["b"]) for r in got)


def test_populations_nest(spark):
    small, large = generate.customers(spark, 50), generate.customers(spark, 120)
    assert small.exceptAll(large).count() == 0
    txns = generate.transactions(small, generate.merchants(spark, 20), 20)
    assert txns.where("cents < 150 or cents > 480000").count() == 0
    per = txns.groupBy("customer_id").count().agg(F.min("count"), F.max("count")).first()
    assert 12 <= per[0] and per[1] <= 60


def test_splice_drops_what_has_no_gap(spark):
    item = "array<struct<lead:string,value:string,category:string>>"
    df = spark.createDataFrame([("One. Two.", [("I am ", "Ada", "PERSON"), ("x ", "y", None), ("z ", "w", "DATE"), ("no ", "room", "DATE")]), ("", [("I am ", "Ada", "PERSON")])], f"t string, i {item}")
    first, empty = (r["r"] for r in df.select(generate.splice(F.col("t"), F.col("i")).alias("r")).collect())
    assert first["text"] == "I am Ada. One. x y. Two. z w." and first["placed"] == 3
    assert [first["text"][s["start"] : s["end"]] for s in first["spans"]] == ["Ada", "w"]
    assert empty["text"].startswith("I am Ada.")


def test_sources(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,text,other\n1,"two\nlines, ""quoted""",x\n2,,y\n')
    got = io.scan_csv(spark, str(tmp_path / "in.csv"), ["id", "text", "other"], ["id", "text"])
    assert [tuple(r) for r in got.collect()] == [("1", 'two\nlines, "quoted"'), ("2", None)]
    io.save_parquet(got, str(tmp_path / "p"))
    assert io.scan_existing(spark, [str(tmp_path / "p"), str(tmp_path / "missing")]).count() == 2
    with pytest.raises(FileNotFoundError):
        io.scan_existing(spark, [str(tmp_path / "missing")])
    io.save_metrics(got, str(tmp_path / "m"))
    io.save_json(got, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    (tmp_path / "t.json").write_text('{"train": {"A": ["x [[name]]", "y"]}, "eval": {"A": ["z"]}}')
    assert {tuple(r) for r in io.scan_templates(spark, str(tmp_path / "t.json")).collect()} == {("train", "A", 0, "x [[name]]"), ("train", "A", 1, "y"), ("eval", "A", 0, "z")}
    assert "quoted" in io.report(got, "Title")
    assert io.provenance(spark, str(tmp_path / "in.csv")).first()["length"] > 0
    with pytest.raises(ValueError):
        io.table(spark, SF, "region", ["nope"])


def test_streaming_gate(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", F.when(F.col("event_id") % 3 == 0, "SSN 123-45-6789").otherwise("clean").alias("text"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = gate.redaction_gate(stream).writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.table("gated").collect()
    assert len(rows) == events.count() and all((r["redacted"] == "SSN [REDACTED]") == (r["event_id"] % 3 == 0) for r in rows)
    query = gate.leak_rate(gate.redaction_gate(stream)).writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    sums = spark.table("rates").agg(F.sum("rows"), F.sum("leaking")).first()
    assert tuple(sums) == (events.count(), events.where("event_id % 3 = 0").count())


def test_utility_rules(spark):
    df = spark.createDataFrame([("a", "A "), ("a", "unknown"), (None, "a"), ("b", None), ("b", "a")], "truth string, answer string")
    assert tuple(utility.grade(df).first()) == (4, 2, 1, 1, 0.5)


def test_single_run_has_no_deviation(spark):
    assert aggregates.spread(spark.createDataFrame([("x", 1.0)], "k string, v double"), "k", "v").first()["stdev"] == 0.0


def test_entry_without_the_training_data_folder():
    """The entry still imports, with fewer queries, when the subpackage and the pipeline are gone."""

    class Hide:
        def find_spec(self, name, path=None, target=None):
            if name in ("umbra.llm", "corpus_pipeline") or name.startswith("umbra.llm."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    kept = {k: sys.modules.pop(k) for k in list(sys.modules) if k == "__spark_entry__" or k == "corpus_pipeline" or k.startswith("umbra.llm")}
    sys.meta_path.insert(0, Hide())
    try:
        entry = importlib.import_module("__spark_entry__")
        assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())
    finally:
        sys.meta_path.pop(0)
        sys.modules.pop("__spark_entry__", None)
        sys.modules.update(kept)


def test_nothing_else_imports_the_training_data_folder():
    root = os.path.dirname(os.path.dirname(os.path.abspath(registry.__file__)))
    for folder, _, files in os.walk(root):
        if os.path.join(root, "llm") in folder:
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "umbra.llm" not in f.read()

def test_postings_are_opened_once_for_a_set_of_merchants(spark):
    pairs = spark.createDataFrame([("red", 1), ("red", 2), ("blue", 2), ("blue", 3)], "merchant string, customer_id int")
    docs = spark.createDataFrame([(k, ["red"]) for k in range(50)] + [(50, ["blue", "red"]), (51, []), (52, ["blue"]), (52, ["red"])], "doc_id int, merchants array<string>")
    got = {r["doc_id"]: r["customers"] for r in linkage.customers_of(docs, pairs).collect()}
    assert got == {k: 2 for k in range(50)} | {50: 3, 52: 3}


def test_sweep_counts_cases_as_it_counts_documents(spark):
    rng = random.Random(4)
    days = [datetime.date(2024, 1, k) for k in (1, 2, 5, 9)]
    txns = spark.createDataFrame([(k, rng.randrange(6), 5000 + 100 * rng.randrange(4), rng.choice(days), rng.choice(["old shop", "new shop", "shop"])) for k in range(60)], "txn_id int, customer_id int, cents bigint, day date, merchant string")
    people = spark.createDataFrame([(k, f"Ann B{'abcdef'[k]}", ["rome", "oslo", "bern"][k % 3]) for k in range(6)], "customer_id int, name string, city string")
    parts = [["", "paid $50.00", "paid $51.00 or $51.00 and $50.00"], ["", "on 1/2/2024", "1/5/24 1/9/2024 1/1/2024"], ["", "at old shop", "new shop old shop"], ["", "in rome", "oslo bern"], ["", "", "I am Ann Ba", "Ann Bb Ann Bc"]]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(p) for p in parts), rng.randrange(6)) for k in range(250)], "doc_id int, text string, customer_id int")
    found = linkage.evidence(docs, txns.select(F.col("merchant").alias("name")), people.select(F.col("city").alias("name")), "Ann B[a-f]").persist()
    sets = linkage.FIELD_SETS | {"merchant+date": ["merchant", "date"]}
    listed = linkage.configuration_list(sets, [(0, 0), (0, 3), (100, 7)])
    flags = linkage.verdicts(docs, linkage.candidates(found, txns, people, listed), linkage.configurations(spark, listed))
    names = {c[0]: (c[1], c[6], c[7]) for c in listed}
    rate = lambda r: tuple(round(r[f"{x}_rate"], 9) for x in ("u", "k", "r", "fp")) + (r["docs"],)
    expected = {names[r["config_id"]]: rate(r) for r in linkage.rates(flags, "config_id").collect()}
    got = {(r["fields"], r["cents"], r["days"]): rate(r) for r in linkage.sweep(docs, found, txns, people, sets, [(0, 0), (0, 3), (100, 7)]).collect()}
    assert got == expected and any(v[0] for v in got.values())
