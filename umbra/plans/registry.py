"""All queries of the engine proper, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.functions import detectors, spans
from umbra.plans import span_queries, table_queries, text_queries  # noqa: F401  the first two register with the third
from umbra.plans.narratives import narratives
from umbra.plans.table_queries import attack_metrics


def queries() -> dict:
    return dict(text_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(text_queries.SQL)


def flagship(spark, sf_dir: str):
    """Re-identification rates of raw and of redacted text over the sweep of configurations."""
    docs = narratives(spark, sf_dir).select("doc_id", "text", "customer_id")
    found = detectors.by_patterns(F.col("text"), detectors.WITH_MONEY | {"PERSON": "Customer#[0-9]{9}"})
    redacted = docs.withColumn("text", spans.replace_spans(F.col("text"), found))
    raw = attack_metrics(spark, sf_dir, docs).withColumn("method", F.lit("raw"))
    return raw.unionByName(attack_metrics(spark, sf_dir, redacted).withColumn("method", F.lit("patterns")))
