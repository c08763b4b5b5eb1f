"""Ranks, samples, splits and set operations that come out alike on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.text import draw


def numbered(df: DataFrame, *keys: str, name: str = "rn") -> DataFrame:
    """0-based position in the order of keys, without a single task that sees all rows.

    keys must tell rows apart, the first one mostly so. Rows are cut into buckets by range of the first key's
    quantiles; a bucket is numbered alone and shifted by what lies before it.
    """
    first = keys[0]
    buckets = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(F.col(first), F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(10_000)).alias("cuts"))
    placed = df.crossJoin(F.broadcast(cuts)).withColumn("_bucket", F.size(F.filter(F.coalesce("cuts", F.array().cast(f"array<{dict(df.dtypes)[first]}>")), lambda c: c < F.col(first)))).drop("cuts")
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)))
    return ranked.join(F.broadcast(before), "_bucket").withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_bucket", "_before", "_at")


def hash_order(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")).cast("binary"))


def sample(df: DataFrame, n: int, key: str, seed: str = "20260806") -> DataFrame:
    """n rows by hash order: a top-n, so no task sorts everything."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def shuffle(df: DataFrame, key: str, seed: str = "20260806") -> DataFrame:
    return df.orderBy(hash_order(seed, key), key)


def hash_split(df: DataFrame, key: str, share: float, seed: str = "split") -> DataFrame:
    """Column split: train or eval, decided by the key alone, so a document never falls on both sides."""
    return df.withColumn("split", F.when(draw(seed, F.col(key), 10_000) < int(share * 10_000), "train").otherwise("eval"))


def without_collisions(df: DataFrame, value: str) -> DataFrame:
    """Rows of a split table whose value isn't on the train side too, and all train rows."""
    train = df.where("split = 'train'")
    clean = df.where("split = 'eval'").join(train.select(value).distinct(), value, "left_anti")
    return train.unionByName(clean.select(train.columns))


def first_of_each(df: DataFrame, by: str, order: str) -> DataFrame:
    """Exact dedup: the row with the smallest order for each value."""
    return df.groupBy(by).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def round_robin(df: DataFrame, key: str, pool: DataFrame, pool_key: str, *keep: str) -> DataFrame:
    """The i-th row of df gets the (i mod n)-th of the pool; n is a scalar on df's side, so the join stays an equi join."""
    n = pool.agg(F.count(F.lit(1)).alias("_n"))
    asked = numbered(df, key).crossJoin(F.broadcast(n)).withColumn("_slot", F.pmod(F.col("rn"), F.col("_n"))).drop("rn", "_n")
    offered = numbered(pool.select(pool_key, *keep), pool_key, name="_slot_p")
    return asked.join(offered, F.col("_slot") == F.col("_slot_p")).drop("_slot", "_slot_p")


def top_per(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def capped(df: DataFrame, value: str, n: int) -> DataFrame:
    """Distinct values in order, the first n."""
    return df.select(value).distinct().orderBy(value).limit(n)
