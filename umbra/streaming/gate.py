"""A streaming redaction gate: what passes is masked, and leak rates are counted by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import detectors, spans


def redaction_gate(stream: DataFrame, text: str = "text", patterns: dict[str, str] | None = None) -> DataFrame:
    """Stateless: each row's text masked, with the number of spans; works on batch and stream alike."""
    found = detectors.by_patterns(F.col(text), patterns or detectors.WITH_MONEY)
    return stream.withColumn("_spans", found).withColumn("redacted", spans.replace_spans(F.col(text), F.col("_spans"))).withColumn("n_spans", F.size("_spans")).drop("_spans", text)


def leak_rate(gated: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Rows and rows with personal data by tumbling window; the watermark bounds the state."""
    return (
        gated.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, window).alias("window"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n_spans") > 0).alias("leaking"))
        .select(F.col("window.start").alias("window_start"), "rows", "leaking")
    )
