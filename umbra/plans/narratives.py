"""The test corpus of the engine: documents with injected evidence, built alike in Spark and in DuckDB.

Each document gets an order by hash, and sentences that tell of it or carry markers.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import text as T
from umbra.operators.ranking import numbered
from umbra.sources.io import table

MARKED = [
    "On XX/XX/2023 XXXX XXXX called about account XXXX.",
    "They owe {$1,200.00} to XXXX since XX/XX/XXXX.",
    "My SSN 123-45-6789 and a.b@mail.com were sent to XXXX XXXX XXXX today.",
    "No markers here, my card is 4111 1111 1111 1111.",
    "XXXtreme and aXX are not markers but XX is.",
    "My card ending in XXXX was charged $ 50.00 on 1/2/2024 3/4/2024 and 5/6/24 7/8/24.",
    "I spoke with XXXX, the manager, and she told me XXXX points were lost on XX / XX / XXXX.",
    "My husband XXXX works for XXXX XXXX, and case number XXXX says he moved to XXXX in XX/2023.",
    "Call (555) 123-4567 or XXXX XXXX at 12 Oak Blvd, 12345-6789, see https://a.example/b?c=1, email me at XXXX.",
    "After the surgery for XXXX I was divorced from XXXX, I am a XXXX and the XXXX branch refused.",
    "They asked for my passport number XXXX and a fee of $XXXX at around XXXX when I bought something at XXXX.",
]

NARR = (
    """
WITH txns AS (
  SELECT o_orderkey AS txn_id, o_custkey AS customer_id, CAST(floor(o_totalprice / 500) AS BIGINT) * 50000 AS cents, CAST(o_orderdate AS DATE) AS day,
    lower(coalesce(p_name, 'none')) AS merchant, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY 1) AS first_line ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = pk
), customers AS (
  SELECT c_custkey AS customer_id, c_name AS name, lower(n_name) AS city FROM customer JOIN nation ON n_nationkey = c_nationkey
), drawn AS (
  SELECT doc_id, text AS body, lang, source,
    ('0x' || substr(md5('order|' || doc_id), 1, 8))::BIGINT % (SELECT count(*) FROM orders) AS slot,
    ('0x' || substr(md5('v|' || doc_id), 1, 8))::BIGINT % 6 AS v, ('0x' || substr(md5('m|' || doc_id), 1, 8))::BIGINT % MARKS AS m
  FROM documents
), facts AS (
  SELECT d.*, t.txn_id, t.customer_id, t.cents, t.day, t.merchant, c.name, c.city,
    '$' || format('{:,}', t.cents // 100) || '.' || lpad((t.cents % 100)::VARCHAR, 2, '0') AS amount, strftime(t.day, '%-m/%-d/%Y') AS long_day, strftime(t.day, '%-m/%-d/%y') AS short_day
  FROM drawn d JOIN txns t ON t.rn = d.slot JOIN customers c ON c.customer_id = t.customer_id
), narr AS (
  SELECT doc_id, lang, source, txn_id, customer_id, cents, day, merchant, name, city, v, m,
    CASE v WHEN 0 THEN 'A charge of ' || amount || ' posted on ' || long_day || ' at ' || merchant || '.'
      WHEN 1 THEN 'A charge of ' || amount || ' posted at ' || merchant || ' in ' || city || '.'
      WHEN 2 THEN 'On ' || long_day || ' I, ' || name || ', paid ' || amount || '.'
      WHEN 3 THEN 'Something at ' || merchant || ' happened on ' || short_day || '.'
      WHEN 4 THEN 'The client ' || name || ' lives in ' || city || '.' ELSE 'Nothing else.' END AS told,
    CASE m """
    + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(MARKED))
    + """ END AS marked, body FROM facts
), narratives AS (SELECT *, body || ' ' || told || ' ' || marked AS text FROM narr)
"""
).replace("MARKS", str(len(MARKED)))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    first = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey"]).groupBy("l_orderkey").agg(F.min("l_partkey").alias("pk"))
    part = table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    joined = orders.join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(part, F.col("p_partkey") == F.col("pk"), "left")
    return joined.select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("customer_id"), (F.floor(F.col("o_totalprice") / 500) * 50_000).alias("cents"), F.col("o_orderdate").cast("date").alias("day"), F.lower(F.coalesce("p_name", F.lit("none"))).alias("merchant")
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    people = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey"])
    return people.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.lower("n_name").alias("city"))


def told(v, amount, long_day, short_day, merchant, city, name):
    return (
        F.when(v == 0, F.concat(F.lit("A charge of "), amount, F.lit(" posted on "), long_day, F.lit(" at "), merchant, F.lit(".")))
        .when(v == 1, F.concat(F.lit("A charge of "), amount, F.lit(" posted at "), merchant, F.lit(" in "), city, F.lit(".")))
        .when(v == 2, F.concat(F.lit("On "), long_day, F.lit(" I, "), name, F.lit(", paid "), amount, F.lit(".")))
        .when(v == 3, F.concat(F.lit("Something at "), merchant, F.lit(" happened on "), short_day, F.lit(".")))
        .when(v == 4, F.concat(F.lit("The client "), name, F.lit(" lives in "), city, F.lit(".")))
        .otherwise(F.lit("Nothing else."))
    )


_kept: dict[tuple[str, str], DataFrame] = {}


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus, kept for the session: nearly every query of the text family starts from it. What an executor loses of it is made again from the tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = _narratives(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return _kept[key]


def _narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]).withColumnRenamed("text", "body")
    txns = numbered(transactions(spark, sf_dir), "txn_id", name="rn")
    n = table(spark, sf_dir, "orders", ["o_orderkey"]).agg(F.count(F.lit(1)).alias("n"))
    drawn = docs.crossJoin(F.broadcast(n)).select("*", T.draw("order", F.col("doc_id"), F.col("n")).alias("slot"), T.draw("v", F.col("doc_id"), 6).alias("v"), T.draw("m", F.col("doc_id"), len(MARKED)).alias("m")).drop("n")
    facts = drawn.join(txns, F.col("rn") == F.col("slot")).join(customers(spark, sf_dir), "customer_id")
    c = F.col
    sentence = told(c("v"), T.money(c("cents")), T.us_date(c("day")), T.us_date(c("day"), short=True), c("merchant"), c("city"), c("name"))
    marked = F.element_at(F.array(*[F.lit(s) for s in MARKED]), (c("m") + 1).cast("int"))
    named = facts.select("doc_id", "lang", "source", "txn_id", "customer_id", "cents", "day", "merchant", "name", "city", "v", "m", "body", sentence.alias("told"), marked.alias("marked"))
    return named.withColumn("text", F.concat_ws(" ", "body", "told", "marked"))
