"""Profiles, distributions and uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions import text as T


def five_numbers(df: DataFrame, value: str) -> DataFrame:
    """Mean, p5, p25, p50, p75, p95 and max by exact linear interpolation."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    one = df.agg(F.avg(value).alias("mean"), q.alias("q"), F.max(value).cast("double").alias("max"))
    return one.select("mean", *[F.col("q")[k].alias(n) for k, n in enumerate(("p05", "p25", "p50", "p75", "p95"))], "max")


def histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, *columns: str, missing: str = "(missing)") -> DataFrame:
    return df.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"))


def ngrams(contexts: DataFrame, words: str, most: int = 120, stop: tuple[str, ...] = ()) -> DataFrame:
    """(n, gram, count) of the last 1 to 3 words of each context, the most frequent of each n; stop words go after the cut."""
    w = F.col(words)
    size = F.size(w)
    grams = F.array(*[F.struct(F.lit(k).alias("n"), F.when(size >= k, F.array_join(F.slice(w, F.greatest(size - (k - 1), F.lit(1)), F.lit(k)), " ")).alias("gram")) for k in (1, 2, 3)])
    rows = contexts.select(F.explode(grams).alias("g")).select("g.*").where("gram is not null and gram <> ''")
    counted = rows.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("count"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("count"), "gram"))).where(F.col("rank") <= most)
    return ranked.where((F.col("n") > 1) | ~F.col("gram").isin(list(stop)) if stop else F.lit(True)).drop("rank")


def with_share(counted: DataFrame, n: str = "n", name: str = "share") -> DataFrame:
    """Share of the total: a scalar of the few counted rows, sent back to them."""
    total = counted.agg(F.sum(n).alias("_total"))
    return counted.crossJoin(F.broadcast(total)).withColumn(name, F.col(n) / F.col("_total")).drop("_total")


def tier_rollup(spans: DataFrame) -> DataFrame:
    """Counts by tier and category, with subtotals by tier and the total."""
    return spans.rollup("tier", "category").agg(F.count(F.lit(1)).alias("n"))


def survival(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(pattern, share) of rows that each pattern is found in: one scan, then unpivoted."""
    one = df.agg(*[F.avg(c.cast("int")).alias(n) for n, c in flags.items()])
    return one.unpivot([], list(flags), "pattern", "share")


def uniqueness(df: DataFrame, values: list[str], owner: str) -> DataFrame:
    """Distinct values, the share owned by exactly one owner, and owners for each value, all exact."""
    known = df.dropna(subset=values)
    owners = known.select(*values, owner).distinct().groupBy(*values).agg(F.count(F.lit(1)).alias("owners"))
    return owners.agg(F.count(F.lit(1)).alias("distinct_values"), F.avg((F.col("owners") == 1).cast("int")).alias("unique_share"), F.avg("owners").alias("owners_per_value"))


def uniqueness_curve(df: DataFrame, values: list[str], owner: str, ordinal: str, sizes: list[int]) -> DataFrame:
    """The same for nested populations: owners of ordinal below each size."""
    spark = df.sparkSession
    pops = spark.createDataFrame([(s,) for s in sizes], "population int")
    grown = df.dropna(subset=values).join(F.broadcast(pops), F.col(ordinal) < F.col("population"))
    owners = grown.select("population", *values, owner).distinct().groupBy("population", *values).agg(F.count(F.lit(1)).alias("owners"))
    return owners.groupBy("population").agg(F.count(F.lit(1)).alias("distinct_values"), F.avg((F.col("owners") == 1).cast("int")).alias("unique_share"), F.avg("owners").alias("owners_per_value"))


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and sample deviation across runs, zero for a single one."""
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"))


def stability(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"), (F.max(value) - F.min(value)).alias("spread"))


def marker_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with words, markers, date markers, braced amounts and the longest run."""
    t = F.col(text)
    return df.select(
        "doc_id", T.word_count(t).alias("words"), T.count_of(t, T.MARKER).alias("markers"), T.count_of(t, T.DATE_MARKER).alias("date_markers"), T.count_of(t, T.BRACED_AMOUNT).alias("braced"), T.longest_run(t).alias("longest_run")
    )


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))


def estimator_accuracy(pairs: DataFrame, unknown: str = "UNKNOWN") -> DataFrame:
    """By true category: rows, correct, unknown, and the most frequent wrong guess (ties by name)."""
    counted = confusion(pairs, "truth", "guess")
    wrong = counted.where((F.col("guess") != F.col("truth")) & (F.col("guess") != unknown))
    top = wrong.groupBy("truth").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("guess").alias("guess")))["guess"].alias("top_confusion"))
    sums = counted.groupBy("truth").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("guess") == F.col("truth"), F.col("n")).otherwise(0)).alias("correct"), F.sum(F.when(F.col("guess") == unknown, F.col("n")).otherwise(0)).alias("unknown"))
    return sums.join(top, "truth", "left")
