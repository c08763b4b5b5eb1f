"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one stable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Rows fall into groups by the 128-bit MD5 of the text. Inside a group the texts
    themselves are part of the grouping key, so two texts that share a hash stay two
    groups. Map-side aggregation collapses the copies within a task first: a text
    held by a third of all rows is shuffled once for each task. The way back from
    group to row joins narrow rows only (hash and digest, no text); a hot group there
    is a large side that adaptive execution can split. keep is "smallest" or "largest":
    which doc_id stays.

    Null text counts as empty; rows with equal doc_id and text are one document
    each, and each of them is kept if its id is; a null doc_id is never the one that
    stays unless its whole group has none. Columns other than doc_id and text are
    not read. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    pick = F.min if keep == "smallest" else F.max
    body = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id"), body.alias("body"), F.unhex(F.md5(body.cast("binary"))).alias("h128"))
    classes = (
        keyed.groupBy("h128", "body")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h128", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows = docs.select(F.col("doc_id"), F.unhex(F.md5(body.cast("binary"))).alias("h128"), F.sha2(body.cast("binary"), 256).alias("text_sha256"))
    return rows.join(classes, ["h128", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row of docs for each text, with the smallest or largest doc_id, all columns as they were."""
    kept = exact_groups(docs, keep).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    stay = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
    return stay.dropDuplicates(["doc_id", "text"])  # rows alike in both
