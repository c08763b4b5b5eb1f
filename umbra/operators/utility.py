"""Utility of redacted text: answers against structured keys, recovery of sources, and comparisons of arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions import text as T


def sentence_sources(altered: DataFrame, originals: DataFrame, least: int = 60, probes: int = 6) -> DataFrame:
    """(doc_id, source_id): the first original that holds one of the longest sentences of an altered text.

    Both sides are exploded to normalised sentences and meet by equality of their
    digests; of several originals with a sentence the smallest id counts. The probes
    longest sentences are tried, the longest first, of equals the one further ahead.
    """
    parted = lambda df, name: df.select(F.col("doc_id").alias(name), F.posexplode(F.transform(T.sentences(F.col("text")), T.answer_key)).alias("at", "s"))
    digest = F.md5(F.col("s").cast("binary")).alias("k")
    known = parted(originals, "source_id").where(F.length("s") >= least).select("source_id", digest).groupBy("k").agg(F.min("source_id").alias("source_id"))
    longest = Window.partitionBy("doc_id").orderBy(F.desc(F.length("s")), "at")
    asked = parted(altered, "doc_id").withColumn("probe", F.row_number().over(longest)).where((F.col("probe") <= probes) & (F.length("s") >= least))
    return asked.select("doc_id", "probe", digest).join(known, "k").groupBy("doc_id").agg(F.min_by("source_id", "probe").alias("source_id"))


def grade(answers: DataFrame, *by: str) -> DataFrame:
    """asked, graded, correct, unknown and accuracy for answers (truth, answer): a null key leaves, UNKNOWN counts apart, a null answer is skipped."""
    known = answers.where("truth is not null")
    unknown = T.answer_key(F.col("answer")) == "unknown"
    graded = F.col("answer").isNotNull() & ~unknown
    right = graded & (T.answer_key(F.col("answer")) == T.answer_key(F.col("truth")))
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(graded).alias("graded"), F.count_if(right).alias("correct"), F.count_if(unknown).alias("unknown"), (F.count_if(right) / F.greatest(F.count_if(graded), F.lit(1))).alias("accuracy")
    )


def majority_baseline(truths: DataFrame, value: str, *by: str) -> DataFrame:
    counted = truths.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.sum("n").alias("gradable"), (F.max("n") / F.sum("n")).alias("baseline"))


def unreachable(truths: DataFrame, options: DataFrame, value: str) -> DataFrame:
    """Rows whose true answer is not among the options: must be none."""
    return truths.where(F.col(value).isNotNull()).join(options, value, "left_anti")


def lost_against(metrics: DataFrame, key: str, value: str, reference: str) -> DataFrame:
    base = metrics.where(F.col(key) == reference).select(F.col(value).alias("_base"))
    return metrics.crossJoin(F.broadcast(base)).withColumn("lost", F.col("_base") - F.col(value)).drop("_base")


def change(metrics: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Last minus first along an order, and the best place, for each group: transfer drops and learning gains."""
    return metrics.groupBy(by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), (F.max_by(value, order) - F.min_by(value, order)).alias("gain"), F.max_by(order, F.struct(F.col(value), -F.col(order))).alias("best_at"))


def verdict(difference: Column, margin: float = 3.0) -> Column:
    return F.when(difference > margin, "better").when(difference < -margin, "worse").otherwise("same")


def throughput(runs: DataFrame, per_hour: float) -> DataFrame:
    """Rate, hours for 300,000 documents and cost of a thousand, from docs and seconds."""
    rate = F.col("docs") / F.col("seconds")
    return runs.select("*", rate.alias("docs_per_s"), (F.lit(300_000) / rate / 3600).alias("hours_300k"), (F.lit(1000) / rate / 3600 * per_hour).alias("cost_per_1k"))


def same_output(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Share of keys on which two runs give the same value, nulls alike."""
    other = b.select(key, F.col(value).alias("_other"))
    return a.join(other, key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).eqNullSafe(F.col("_other")).cast("int")).alias("same_share"))


def disjoint(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """How many values two sets share, and how many each has alone."""
    left, right = a.select(value).distinct(), b.select(value).distinct()
    return left.intersect(right).agg(F.count(F.lit(1)).alias("shared")).crossJoin(left.exceptAll(right).agg(F.count(F.lit(1)).alias("only_a"))).crossJoin(right.exceptAll(left).agg(F.count(F.lit(1)).alias("only_b")))
