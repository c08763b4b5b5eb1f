"""Shared pieces: reading documents, cutting lineage, global ranks, component labels."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text with null as empty; other columns, whatever their names, stay out of the plan."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most so many bytes of a text column (or one longer text): what Python makes of them stays small."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            below = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, below + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    settle()


def settle() -> None:
    """Give memory that is free back to the system: workers stay when their task is over, and others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


class Memo(dict):
    """Values that a worker process remembers, up to a bound in bytes; then it starts anew."""

    known: dict[str, list[Memo]] = {}

    def __init__(self, owner: str, most: int):
        super().__init__()
        self.most, self.size = most, 0
        self.known.setdefault(owner, []).append(self)

    def put(self, key, value, size: int):
        if self.size + size > self.most:
            self.empty()
        self.size += size
        self[key] = value
        return value

    def empty(self) -> None:
        self.clear()
        self.size = 0

    @classmethod
    def enter(cls, owner: str) -> None:
        """A task of this owner starts: what others remember in this process goes, since Spark uses its workers again."""
        for name, memos in cls.known.items():
            if name != owner:
                for memo in memos:
                    memo.empty()
        settle()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share. Where none is named, a temporary one serves a session that runs in one process; a cluster has to name one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="umbra-checkpoints-"))
    return context.getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder as Parquet and read back: lineage ends here, and a lost executor costs nothing written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/umbra-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def discard(df: DataFrame) -> None:
    """Delete what materialise wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect what nothing refers to any more: Spark deletes the shuffle files behind a plan only then, and its heap can take long to fill."""
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_global_rank(df: DataFrame, keys: list[str | Column], rank: str = "rank", total: str = "total") -> DataFrame:
    """Adds the 0-based position of each row in the order of keys, and the number of rows.

    A range shuffle sorts; ranks come from the position in the partition plus the
    sizes of the partitions before it, so that no task sees more than its share.
    df should be narrow: it is written out once, since a second run of the range
    shuffle could cut elsewhere.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys)
    placed = materialise(
        dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias(total),
    )
    # one row for each shuffle partition: bounded by the width of the shuffle
    return placed.join(F.broadcast(before), "_part").withColumn(rank, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def component_labels(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star contraction: each round is two
    aggregations by node, all distributed, and the number of rounds grows with the
    logarithm of the longest chain. Edges stay distinct, so they never multiply.
    """
    links = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the larger neighbours of u move to the smallest of u and its neighbours
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        before, links = links, materialise(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        )
        discard(before)
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
