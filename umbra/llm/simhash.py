"""SimHash near-duplicates: an inverted index of positional bytes with count filtering, then components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import Memo, component_labels, id_and_text, materialise, sliced
from umbra.llm.exchange import MULTIPLIER, meeting_positions, mix

BYTES = 8
BLOCK = 4096  # most fingerprints of one posting that meet in one task, taken two blocks at a time


# byte -> its bits in the lanes of a word, lowest first
_LANES = np.array([sum((b >> j & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """For hashes of shape (shingles, words): words in which a bit is set if it is in over half of the shingles."""
    raw = hashes.view(np.uint8).reshape(len(hashes), -1)
    counts = np.zeros((raw.shape[1], 8), np.int64)
    for at in range(0, len(raw), 255):  # lanes hold up to 255
        counts += _LANES[raw[at : at + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").ravel().view(np.uint64)


def _longer(hashes: np.ndarray, words: int) -> np.ndarray:
    """Shape (shingles, words): the hashes themselves, then others made from them."""
    out = np.empty((len(hashes), words), np.uint64)
    out[:, 0] = hashes
    for k in range(1, words):
        h = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = h ^ (h >> np.uint64(31))
    return out


def long_fingerprint(text: str, width: int, words: int) -> np.ndarray:
    """words * 64 bits, each set if set in over half of the hashes of the shingles; zero if there are no words. The first 64 are by XXH64 itself."""
    raw = text.encode().lower().split()  # bytes: only ASCII letters and white space count
    if not raw:
        return np.zeros(words, np.uint64)
    if len(raw) <= width:
        hashes = np.array([_hash(b" ".join(raw))], np.uint64)
    else:
        hashes = np.fromiter(map(_hash, map(b" ".join, zip(*(raw[k:] for k in range(width)), strict=False))), np.uint64, len(raw) - width + 1)
    return _majority(_longer(hashes, words)) if words > 1 else _majority(hashes[:, None])


def fingerprint(text: str, width: int) -> int:
    """64 bits, each set if set in over half of the shingles' XXH64 hashes; 0 if there are no words."""
    return int(long_fingerprint(text, width, 1)[0])


def _hash(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, 42)


def fingerprints(docs: DataFrame, width: int = 5, words: int = 1) -> DataFrame:
    """doc_id and the fingerprint: a signed long, or bytes where it has more words."""
    slim = id_and_text(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.enter("simhash")
        for batch in sliced(batches):
            found = [long_fingerprint(t, width, words) for t in batch.column(1).to_pylist()]
            col = pa.array(np.concatenate(found).view(np.int64)) if words == 1 else pa.array([f.tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), col], ["doc_id", "fp"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp {'long' if words == 1 else 'binary'}")


def posting_keys(differ: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that fingerprints at most differ bits apart agree on all of one.

    Such a pair shares at least 8 - differ positional bytes. Postings of single bytes
    would each hold a 256th of all documents, so postings are kept for the sets of
    three positions inside either half: of any five positions three lie in one half.
    With more bits let differ, the sets shrink to what the guarantee still covers.
    """
    shared = BYTES - differ
    if shared < 1:
        raise ValueError("no positional byte is guaranteed to match")
    size = (shared + 1) // 2  # the larger part of the shared positions falls in one half
    return [s for half in (range(4), range(4, 8)) for s in combinations(half, size)]


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def close_pairs(fps: np.ndarray, differ: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs at most differ bits apart: shared bytes are tallied, pairs with too few dropped, the rest verified."""
    if len(fps) == 2:
        both = int(fps[0]) ^ int(fps[1])
        if sum(not both >> s & 255 for s in range(0, 64, 8)) >= BYTES - differ and both.bit_count() <= differ:
            yield 0, 1
        return
    forest = _Forest(len(fps))
    for at in range(0, len(fps), 256):
        both = fps[at : at + 256, None] ^ fps[None, :]
        tally = np.zeros(both.shape, np.uint8)
        for s in range(0, 64, 8):
            tally += (both >> np.uint64(s)) & np.uint64(255) == 0
        left, right = np.nonzero((tally >= BYTES - differ) & (np.arange(len(fps))[None, :] > np.arange(at, at + both.shape[0])[:, None]))
        near = np.bitwise_count(both[left, right]) <= differ
        for a, b in zip((left[near] + at).tolist(), right[near].tolist(), strict=True):
            if forest.join(a, b):
                yield a, b


def near_links(nodes: DataFrame, differ: int = 3) -> DataFrame:
    """Links (a, b) that connect all nodes (node, fp; distinct fp) at most differ bits apart.

    Each posting gives a spanning forest of its close pairs, never all of them. A
    posting of over BLOCK fingerprints is dealt in blocks, and each two blocks meet in
    a task of their own: memory stays bounded and no pair is missed.
    """
    parts = []
    for k, where in enumerate(posting_keys(differ)):
        key = F.lit(k).cast("long")
        for p in where:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255)))
        parts.append(key)
    posted = nodes.select("node", "fp", F.explode(F.array(*parts)).alias("key"))
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    shared = posted.join(sizes, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = shared.select("node", "fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fp"
    )
    grouped = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        kept: list[np.ndarray] = []

        def pairs(rows: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            ends = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1
            starts = np.concatenate([[0], ends])
            stops = np.concatenate([ends, [len(rows)]])
            for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
                if e - s < 2:
                    continue
                ids, fps = rows[s:e, 3], rows[s:e, 4].astype(np.int64).view(np.uint64)
                for x, y in close_pairs(np.ascontiguousarray(fps), differ):
                    a.append(int(ids[x]))
                    b.append(int(ids[y]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            rows = np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            kept.append(rows)
            if np.any(rows[-1, :3] != kept[0][0, :3]):
                whole = np.concatenate(kept)
                last = int(np.flatnonzero(np.any(whole[:, :3] != whole[-1, :3], axis=1))[-1]) + 1
                yield pairs(whole[:last])
                kept = [whole[last:]]
        if kept:
            yield pairs(np.concatenate(kept))

    return grouped.mapInArrow(run, "a long, b long")


WORDS = 8  # 64-bit words of a long fingerprint
SHARED = 8  # of its 64 bytes a pair must share so many: at a similarity of 0.8 it shares 17 on average, and 8 with a chance of 0.998
# steps from a byte position to the others of its set of three: any two sets share one position at most. The sets are the same for any number of documents
TRIPLES = ((1, 3), (5, 12), (9, 25))
MARGIN = 0.02  # by which the estimate may fall short of the similarity asked for, so that pairs at the limit are seldom lost
FIRST = 8  # of so many sets of positions one is taken before the others: 24 of 192, spread over all bytes
LONG_BLOCK = 1 << 16  # most long fingerprints of one posting that meet in one task, taken two blocks at a time


def differing_bits(similarity: float, bits: int = 64 * WORDS) -> float:
    """Bits in which fingerprints of two equally long texts of that Jaccard similarity differ on average: the angle between their shingle vectors."""
    return bits * math.acos(2 * similarity / (1 + similarity)) / math.pi


def posting_sets() -> np.ndarray:
    """Sets of byte positions of a long fingerprint."""
    return np.array([[i, *((i + s) % (8 * WORDS) for s in more)] for more in TRIPLES for i in range(8 * WORDS)])


def posting_codes(fps: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """A 64-bit code for each fingerprint (rows of bytes) and set: the number of the set and the bytes at its positions."""
    code = np.broadcast_to(np.arange(len(sets), dtype=np.uint64), (len(fps), len(sets)))
    for k in range(sets.shape[1]):
        code = (code << np.uint64(8)) | fps[:, sets[:, k]].astype(np.uint64)
    return mix(code * MULTIPLIER)


def connecting_links(fps: np.ndarray, differ: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of rows (bytes) that share SHARED bytes or more and differ in at most differ bits.

    Grown from one row after another: those reached are compared with those not yet
    reached only, so a group of copies costs a few passes and no pairs.
    """
    words = np.ascontiguousarray(fps).view(np.uint64)
    left = np.arange(len(fps))
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            step = max(1, (1 << 16) // len(left))
            now, reached = reached[:step], reached[step:]
            shared = (fps[now][:, None, :] == fps[left][None, :, :]).sum(axis=2, dtype=np.uint8)
            a, b = np.nonzero(shared >= SHARED)
            near = np.bitwise_count(words[np.array(now)[a]] ^ words[left[b]]).sum(axis=1, dtype=np.int64) <= differ
            a, b = a[near], b[near]
            hit, at = np.unique(b, return_index=True)
            for x, y in zip(a[at].tolist(), left[hit].tolist(), strict=True):
                yield int(now[x]), y
            reached += left[hit].tolist()
            left = np.delete(left, hit)


def long_labels(nodes: DataFrame, differ: int) -> DataFrame:
    """(node, component) for the nodes (node long, fp bytes; distinct fp) that may be near any other; component is the smallest node reachable.

    Postings are kept by sets of byte positions. Which codes meet at all is told by a
    packed exchange, so only postings of two or more are made as rows. In a posting
    shared bytes are tallied, pairs with too few dropped, and the others verified bit by
    bit. One set in FIRST is taken alone and its links made components; by the others
    only components are linked, so a group of copies, which meets in every set, brings
    no links between its own members again, and postings within a component are done
    with before anything is compared.
    """
    sets = posting_sets()

    def code(texts: list[bytes], _: list):
        codes = posting_codes(np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1), sets)
        return np.full(len(texts), len(sets)), np.arange(codes.size), codes.ravel(), np.zeros(codes.size, bool)

    met = materialise(meeting_positions(nodes.select(F.col("node").alias("doc_id"), F.lit(0).cast("long").alias("key"), F.col("fp").alias("text")), code, anchored=False, unit_bytes=1 << 18))
    rows = nodes.join(met.select(F.col("doc_id").alias("node"), "hits"), "node").select("node", "fp", "hits")

    def postings(named: DataFrame, first: bool) -> DataFrame:
        """(key, node, fp) of the first sets or of the others."""

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    fps = part.column(1).to_pylist()
                    hits = [h.values.to_numpy(zero_copy_only=False) for h in part.column(2)]
                    hits = [h[(h % FIRST == 0) == first] for h in hits]
                    codes = posting_codes(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), sets)
                    owner = np.repeat(np.arange(len(fps)), [len(h) for h in hits])
                    found = pa.array(codes[owner, np.concatenate(hits)].view(np.int64))
                    yield pa.RecordBatch.from_arrays([found, *(part.column(k).take(pa.array(owner)) for k in range(2))], ["key", "node", "fp"])

        return named.mapInArrow(post, "key long, node long, fp binary")

    known = component_labels(_forests(postings(rows, True), differ))
    named = rows.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    merged = component_labels(_forests(postings(named.select(F.col("component").alias("node"), "fp", "hits"), False), differ))
    last = merged.select(F.col("node").alias("component"), F.col("component").alias("last"))
    return named.select("node", "component").join(last, "component", "left").select("node", F.coalesce("last", "component").alias("component"))


def _forests(posted: DataFrame, differ: int) -> DataFrame:
    """Links (a, b) that connect the near ones of each posting (key, node, fp), a being the smallest node that b reaches there.

    Several fingerprints of one node count as linked. A group of copies meets in many
    postings, and a forest grown anew in each would link every copy to other ones each
    time. Stars round the smallest nodes are nearly the same in all of them. A posting of
    over LONG_BLOCK fingerprints is dealt in blocks of which each two meet.
    """
    large = materialise(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG_BLOCK))
    if large.isEmpty():
        dealt = posted.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "fp")
    else:
        blocks = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(LONG_BLOCK)).cast("int")
        shared = posted.join(large, "key", "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        dealt = shared.select("node", "fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
            "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fp"
        )
    grouped = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        seen: set[tuple[int, int]] = set()  # a pair of copies meets in many postings

        def links() -> Iterator[pa.RecordBatch]:
            names, place = (x.tolist() for x in np.unique([n for n, _ in held], return_inverse=True))
            forest = _Forest(len(names))  # the smallest place is the root
            if len(names) > 1:
                fps = np.frombuffer(b"".join(f for _, f in held), np.uint8).reshape(len(held), -1)
                for x, y in connecting_links(fps, differ):
                    forest.join(place[x], place[y])
            found = {(names[root], names[x]) for x in range(len(names)) if (root := forest.root(x)) != x} - seen
            if len(seen) < 200_000:
                seen.update(found)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], ["a", "b"])

        at = None
        for batch in batches:
            for key, i, j, node, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != at:
                    if len(held) > 1:
                        yield from links()
                    at, held = (key, i, j), []
                held.append((node, fp))
        if len(held) > 1:
            yield from links()

    return grouped.mapInArrow(run, "a long, b long").distinct()


NO_ID = 1 << 62  # from here on nodes stand for texts that no row with an id has


def simhash_groups(docs: DataFrame, width: int = 5, differ: int = 3, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits, or 128) and component_id for every row of docs.

    Documents link when their 64-bit fingerprints differ in at most differ bits, without
    a miss. If a similarity is given, fingerprints of 512 bits link instead when the
    bits that differ are as few as at that Jaccard similarity of shingles less MARGIN.
    That estimate has an error of 0.04, and the index is by chance as well: of pairs at
    the limit some are missed, of those 0.05 above it hardly any.

    component_id is the smallest doc_id reachable over links. Equal fingerprints are one
    node, so copies cost one row however many there are. Repeated rows share a
    component. Texts of fewer than width words have one shingle; texts without words
    (null and empty ones too) have fingerprint zero and link like any other. Rows with
    a null id link, too, and are named by the ids they reach, or null. Columns other
    than doc_id and text are not read; doc_id is a number below 2**62.
    """
    long = similarity is not None
    prints = materialise(fingerprints(docs, width, WORDS if long else 1))
    stand_in = F.lit(NO_ID) + F.pmod(F.xxhash64("fp"), F.lit(NO_ID - 1))
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("least")).select("fp", F.coalesce("least", stand_in).alias("node")))
    labels = long_labels(nodes, math.floor(differing_bits(similarity - MARGIN))) if long else component_labels(near_links(nodes, differ))
    named = nodes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    shown = F.lower(F.hex("fp")) if long else F.lower(F.lpad(F.hex("fp"), 16, "0"))
    component = F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id")
    return prints.join(named, "fp").select("doc_id", shown.alias("fingerprint"), component)


def drop_near_copies(docs: DataFrame, width: int = 5, differ: int = 3, similarity: float | None = None) -> DataFrame:
    """The row with the smallest doc_id of each component stays, all columns as they were; where no row of a component has an id, all stay."""
    kept = simhash_groups(docs, width, differ, similarity).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
