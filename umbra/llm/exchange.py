"""Packed exchange: which hash codes of all documents meet, without a row for each code.

Documents are taken in units of a few MB. A unit's codes are split by bucket of the
hash and travel as one binary row for each unit and bucket; a bucket's task finds the
codes that meet and answers each unit with positions, and a unit's answers come
together again as positions in each document. What a task holds is one bucket or one
unit; buckets grow in number with the width of the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import Memo, settle, shuffle_width

UNIT_BYTES = 4_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))

# texts (bytes), extra column values -> (length of each text, ascending positions in their concatenation, codes, flags)
Coder = Callable[[list[bytes], list], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of MULTIPLIER and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        _powers["up"] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, MULTIPLIER))])
        _powers["down"] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, INVERSE))])
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rolling(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width symbols (random 64-bit values); one for each start, none if too short."""
    n = len(symbols)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up, out=total[1:])
    return mix((total[width:] - total[: n - width + 1]) * down[: n - width + 1])


def rolled_at(symbols: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The values of rolling at some starts."""
    up, down = powers(len(symbols))
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up, out=total[1:])
    return mix((total[at + width] - total[at]) * down[at])


def _units(batches: Iterator[pa.RecordBatch], unit_bytes: int) -> Iterator[tuple[list[int], list[int], list[bytes], list]]:
    """(ids, keys, texts, extra) for up to unit_bytes of text, or one longer text."""
    ids: list[int] = []
    keys: list[int] = []
    texts: list[bytes] = []
    extra: list = []
    size = 0
    for batch in batches:
        more = batch.column(3) if batch.num_columns > 3 else None
        for k in range(batch.num_rows):
            text = batch.column(2)[k].as_py() or b""
            text = text.encode() if isinstance(text, str) else text
            if size + len(text) > unit_bytes and ids:
                yield ids, keys, texts, extra
                ids, keys, texts, extra, size = [], [], [], [], 0
            ids.append(batch.column(0)[k].as_py())
            keys.append(batch.column(1)[k].as_py())
            texts.append(text)
            extra.append(None if more is None else more[k].values.to_numpy(zero_copy_only=False))
            size += len(text)
    if ids:
        yield ids, keys, texts, extra


def meeting_positions(keyed: DataFrame, coder: Coder, anchored: bool, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """(doc_id, key, hits): for each document the sorted positions whose codes meet another.

    keyed has doc_id long, key long, text (or bytes) and maybe one column of integer arrays that
    the coder gets. anchored: a code meets the flagged codes of other positions;
    otherwise it meets any equal code elsewhere. Codes count as equal by 64 bits (31 if
    anchored, for a filter that is verified later) besides the bucket. Documents with no
    hit are left out.
    """
    buckets = max(16, shuffle_width(keyed.sparkSession))
    code_type = np.uint32 if anchored else np.uint64

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        Memo.enter("anchors")
        for number, (ids, keys, texts, extra) in enumerate(_units(batches, unit_bytes)):
            lengths, at, codes, flags = coder(texts, extra)
            about = np.concatenate([np.array(ids, np.int64), np.array(keys, np.int64), lengths.astype(np.int64)]).tobytes()
            own = ((codes >> np.uint64(44)) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
            order = np.argsort(own, kind="stable")
            bounds = np.searchsorted(own[order], np.arange(buckets + 1))
            sent = ((codes & np.uint64(0x7FFFFFFF)) << np.uint64(1) | flags.astype(np.uint64)).astype(np.uint32) if anchored else codes
            sent, at = sent[order], at[order]
            rows: list[tuple] = [((part << 32) + number, -1, about, b"", b"", 0)]
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                s, e = bounds[b], bounds[b + 1]
                gaps = np.diff(at[s:e])
                small = np.uint16 if not len(gaps) or gaps.max() < 65536 else np.uint32
                rows.append(((part << 32) + number, b, b"", sent[s:e].tobytes(), gaps.astype(small).tobytes(), int(at[s])))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), kinds, strict=True)], ["unit", "bucket", "about", "codes", "gaps", "first"])

    def meet(held: list[tuple[int, bytes, bytes, int]]) -> Iterator[tuple[int, bytes]]:
        codes = [np.frombuffer(c, code_type) for _, c, _, _ in held]
        every = np.concatenate(codes)
        if anchored:
            known, counts = np.unique(every[every & 1 == 1] >> 1, return_counts=True)
        else:
            every.sort()
            again = every[1:][every[1:] == every[:-1]]
            known = again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again
        if not len(known):
            return
        for (unit, _, gaps, first), own in zip(held, codes, strict=True):
            look = own >> 1 if anchored else own
            place = np.minimum(np.searchsorted(known, look), len(known) - 1)
            hit = known[place] == look
            if anchored:
                hit &= (counts[place] > 1) | (own & 1 == 0)
            if hit.any():
                small = np.uint16 if len(gaps) == 2 * (len(own) - 1) else np.uint32
                at = first + np.concatenate([[0], np.cumsum(np.frombuffer(gaps, small), dtype=np.int64)])
                yield unit, at[hit].astype(np.uint32).tobytes()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64(), pa.binary(), pa.binary()], ["unit", "about", "hits"]
        Memo.enter("exchange")
        bucket, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for unit, b, about, codes, gaps, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b < 0:
                    out.append((unit, about, b""))
                    continue
                if b != bucket and held:
                    out += [(u, b"", h) for u, h in meet(held)]
                    held = []
                bucket = b
                held.append((unit, codes, gaps, first))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if held:
            for u, h in meet(held):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((u, b"", h), kinds, strict=True)], names)
            held = []
            settle()

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, about, hits = None, b"", []

        def close() -> Iterator[pa.RecordBatch]:
            ids, keys, lengths = np.frombuffer(about, np.int64).reshape(3, -1)
            ends = np.cumsum(lengths)
            at = np.sort(np.concatenate(hits)).astype(np.int64)
            bounds = np.concatenate([[0], np.searchsorted(at, ends)])
            full = np.flatnonzero(np.diff(bounds))
            found = [(at[bounds[k] : bounds[k + 1]] - (ends[k] - lengths[k])).astype(np.int32) for k in full]
            yield pa.RecordBatch.from_arrays([pa.array(ids[full]), pa.array(keys[full]), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "key", "hits"])

        for batch in batches:
            for u, a, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != unit:
                    if hits:
                        yield from close()
                    unit, about, hits = u, b"", []
                about = a or about
                if h:
                    hits.append(np.frombuffer(h, np.uint32))
        if hits:
            yield from close()

    rows = keyed.mapInArrow(send, "unit long, bucket int, about binary, codes binary, gaps binary, first long")
    # a partition for each bucket, so that no two buckets meet by chance; the rows about units are dealt over all
    place = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("unit"), F.lit(buckets))).otherwise(F.col("bucket"))
    dealt = rows.repartitionById(buckets, place.cast("int")).sortWithinPartitions("bucket", "unit")
    met = dealt.mapInArrow(answer, "unit long, about binary, hits binary")
    found = met.repartition("unit").sortWithinPartitions("unit").mapInArrow(join_up, "doc_id long, key long, hits array<int>")
    return found.groupBy("doc_id", "key").agg(F.first("hits").alias("hits"))  # rows alike in id and text have equal hits
