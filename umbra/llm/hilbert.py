"""Sharding by a Hilbert curve over quantised metadata, all in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import with_global_rank


def curve_steps(n: int) -> list[tuple[int, int]]:
    """(digit, next state) for state * 2**n + quadrant; a state is entry corner * n + direction.

    Built from the reflected Gray code: a cell's sub-cube is turned by the entry
    corner and the direction of travel, and its Gray rank is the digit.
    """
    full = (1 << n) - 1

    def turn(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & full

    def rank(code: int) -> int:
        out = 0
        while code:
            out ^= code
            code >>= 1
        return out

    def corner(digit: int) -> int:
        even = 2 * ((digit - 1) // 2)
        return 0 if digit == 0 else even ^ (even >> 1)

    def axis(digit: int) -> int:
        if digit == 0:
            return 0
        ones, x = 0, digit if digit & 1 else digit - 1
        while x & 1:
            ones, x = ones + 1, x >> 1
        return ones % n

    steps = []
    for state in range(n << n):
        entry, heading = divmod(state, n)
        for quadrant in range(1 << n):
            digit = rank(turn(quadrant ^ entry, -(heading + 1)))
            steps.append((digit, (entry ^ turn(corner(digit), heading + 1)) * n + (heading + axis(digit) + 1) % n))
    return steps


def curve_index(dims: list[Column], bits: int) -> Column:
    """Position on the curve of a cell; dims are integers in 0..2**bits-1."""
    n = len(dims)
    if not 2 <= n * bits <= 62:
        raise ValueError("the index must fit a long")
    steps = curve_steps(n)
    packed = F.array(*[F.lit(digit | (state << n)) for digit, state in steps])  # one table, digit in the low bits

    def step(at: Column, level: Column) -> Column:
        quadrant = sum(((F.call_function("shiftright", d.cast("int"), level) .bitwiseAND(F.lit(1))) * F.lit(1 << k) for k, d in enumerate(dims)), F.lit(0))
        found = F.element_at(packed, (at["state"] * F.lit(1 << n) + quadrant + F.lit(1)).cast("int"))
        digit = found.bitwiseAND(F.lit((1 << n) - 1))
        return F.struct(
            F.shiftright(found, n).cast("int").alias("state"),
            (at["index"] * F.lit(1 << n) + digit).cast("long").alias("index"),
        )

    levels = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    start = F.struct(F.lit(0).cast("int").alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(levels, start, step, lambda at: at["index"])


def category(col: Column, bits: int) -> Column:
    """Null is cell 0; values are dealt over the others by hash, however many there are."""
    return F.when(col.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(col.cast("string")), F.lit((1 << bits) - 1)) + 1).cast("int")


def magnitude(col: Column, bits: int) -> Column:
    """Two cells for each doubling; null is cell 0."""
    cell = F.floor(F.lit(2.0) * F.log2(F.greatest(col.cast("double"), F.lit(1.0)))).cast("int")
    return F.coalesce(F.least(F.greatest(cell, F.lit(0)), F.lit((1 << bits) - 1)), F.lit(0))


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = 6, dims: tuple[tuple[str, str], ...] = (("lang", "category"), ("source", "category"), ("size", "magnitude"))) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and hilbert for every row of docs.

    Rows are sorted by curve index (then text checksum and doc_id, so that equal texts
    of one cell stand together) and cut into runs whose row counts differ by one at
    most: law "rows". size is the UTF-8 bytes of the text plus 8; "size" is also a
    dimension that dims may name besides columns of docs. grown_shard is null: this
    law moves rows when a shard is added.

    Null text has size 8 and the checksum of no bytes; a null or missing metadata
    value is cell 0 of its dimension. Rows that are alike in every key have some order
    among themselves and distinct slots. An empty table gives an empty result. Columns
    that dims doesn't name are not read, clashing names included.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    have = {c.lower() for c in docs.columns}
    size = (F.octet_length(body) + F.lit(8)).cast("long")
    named = [("_dim%d" % k, size if c == "size" else F.col(c) if c.lower() in have else F.lit(None), kind) for k, (c, kind) in enumerate(dims)]
    cells = docs.select("doc_id", size.alias("size"), F.crc32(body).alias("text_crc32"), *[(category if kind == "category" else magnitude)(v, bits).alias(a) for a, v, kind in named])
    narrow = cells.select("doc_id", "size", "text_crc32", curve_index([F.col(a) for a, _, _ in named], bits).alias("hilbert"))
    ranked = with_global_rank(narrow, ["hilbert", "text_crc32", "doc_id"])
    shard = F.expr(f"rank * {shards} div total")
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
    )


def zone_map(docs: DataFrame, placed: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest and largest value of each column in each shard: which files a filter can skip."""
    tied = placed.select("doc_id", "shard").join(docs.select("doc_id", *columns), "doc_id")
    return tied.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
