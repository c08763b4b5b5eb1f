"""Suffix-array dedup of byte strings: difference-cover suffix sorting over the places that can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.anchors import keyed_documents, real_id
from umbra.llm.common import discard, materialise, release, sliced
from umbra.llm.exchange import meeting_positions, rolled_at, rolling

GRAM = 48  # bytes hashed to pick anchors
PROBE = 256  # bytes of the shorter strings that n_repeated counts
SORTED_BYTES = 600_000  # text sorted at once
LARGE_CLASS = 3_000_000  # bytes of one class beyond which its windows are spread over tasks by their hashes
BODY_BATCH = 4_000_000  # bytes of stretches sent on at once
SENT = 200_000  # stretches whose body a task remembers to have sent
_BYTE_VALUES = np.array([xxhash.xxh64_intdigest(bytes([b]), 29) for b in range(256)], np.uint64)
_OTHER_VALUES = np.array([xxhash.xxh64_intdigest(bytes([b]), 31) for b in range(256)], np.uint64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of integers from 0 to 2**31 - 2 by the difference cover of 3.

    Suffixes at positions 1 and 2 modulo 3 are sorted by their triples and named; if
    names repeat, the string of names is sorted recursively. The others are sorted by
    their first symbol and the rank behind it, and both orders are merged.
    """
    n = len(text)
    if n < 40:
        return np.array(sorted(range(n), key=lambda k: text[k:].tolist()), np.int64)
    t = np.concatenate([text.astype(np.int64) + 1, np.zeros(3, np.int64)])
    bits = int(t.max()).bit_length()
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # one position past the end keeps the halves apart
    sampled = np.concatenate([ones, twos])
    pairs, last = (t[sampled] << bits) | t[sampled + 1], t[sampled + 2]  # symbols are below the length, so two fit 63 bits
    if 3 * bits <= 63:
        triples = (pairs << bits) | last
        order = np.argsort(triples)
        fresh = np.concatenate([[0], np.cumsum(np.diff(triples[order]) != 0)])
    else:
        order = np.lexsort((last, pairs))
        fresh = np.concatenate([[0], np.cumsum((np.diff(pairs[order]) != 0) | (np.diff(last[order]) != 0))])
    if fresh[-1] + 1 < len(sampled):
        names = np.empty(len(sampled), np.int64)
        names[order] = fresh
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sampled[order]] = np.arange(1, len(sampled) + 1)
    sampled = sampled[order]
    if n % 3 == 1:
        sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    width = int(len(rank)).bit_length()
    zeros = zeros[np.argsort((t[zeros] << width) | rank[zeros + 1])]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    # against positions 1 mod 3 one symbol and a rank decide, against 2 mod 3 two symbols and a rank
    short = lambda p: (t[p] << width) | rank[p + 1]
    before = np.searchsorted(short(first), short(zeros))
    if 2 * bits + width <= 63:
        long = lambda p: (t[p] << (bits + width)) | (t[p + 1] << width) | rank[p + 2]
        before = before + np.searchsorted(long(second), long(zeros))
    else:
        both = np.concatenate([second, zeros])
        joint = np.lexsort((np.arange(len(both)) < len(second), rank[both + 2], t[both + 1], t[both]))
        seen = np.cumsum(joint < len(second))
        before = before + seen[joint >= len(second)]
    out = np.full(n, -1, np.int64)
    out[np.arange(len(zeros)) + before] = zeros
    out[out < 0] = sampled
    return out


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of width values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors_of(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor positions, their hashes): the leftmost smallest gram of every window of bytes."""
    grams = rolling(_BYTE_VALUES[np.frombuffer(text, np.uint8)], GRAM)
    width = window - GRAM + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    best = _sliding(np.concatenate([edge, low, edge]), width, np.maximum)
    at = np.flatnonzero(best == grams)  # smallest in some window, ties included
    return at, grams[at]


def _served(at: np.ndarray, codes: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor number, first start, last start) of the windows whose anchor each anchor is, where there are any."""
    width = window - GRAM + 1
    # an anchor serves starts from behind the last anchor before it that is as small, to before the next smaller one
    stack: list[int] = []
    nearest = np.full(len(at), -1, np.int64)
    after = np.full(len(at), n, np.int64)
    values, places = codes.tolist(), at.tolist()
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            after[stack.pop()] = places[k]
        if stack:
            nearest[k] = places[stack[-1]]
        stack.append(k)
    first = np.maximum(np.maximum(at - width + 1, nearest + 1), 0)
    last = np.minimum(np.minimum(at, after - width), n - window)
    number = np.flatnonzero(first <= last)
    return number, first[number], last[number]


def stretches_of(text: bytes, probe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, first start, last start) by rising start: each window of probe bytes belongs to one stretch, equal windows to stretches of one class.

    A window holds its anchor and, before or behind it, half of the rest or more. So the
    starts that an anchor serves are parted in two, and the class is a hash of the
    anchor together with the half that all windows of the part hold.
    """
    at, grams = anchors_of(text, probe)
    number, first, last = _served(at, grams, len(text), probe)
    at = at[number]
    side = (probe - GRAM) // 2
    before, behind = np.flatnonzero(first <= at - side), np.flatnonzero(last > at - side)
    codes = rolled_at(_OTHER_VALUES[np.frombuffer(text, np.uint8)], GRAM + side, np.concatenate([at[before] - side, at[behind]]))
    codes[: len(before)] |= np.uint64(1)
    codes[len(before) :] &= ~np.uint64(1)
    start = np.concatenate([first[before], np.maximum(first, at - side + 1)[behind]])
    stop = np.concatenate([np.minimum(last, at - side)[before], last[behind]])
    order = np.argsort(start)
    return codes[order], start[order], stop[order]


def stretch_coder(probe: int):
    """The class of each stretch, placed at its first start."""

    def code(texts: list[bytes], _: list):
        lengths = np.array([len(t) for t in texts], np.int64)
        found = [stretches_of(t, probe) for t in texts]
        at = np.concatenate([s + start for s, (_, start, _) in zip(np.cumsum(lengths) - lengths, found, strict=True)]).astype(np.int64)
        return lengths, at, np.concatenate([c for c, _, _ in found]), np.zeros(len(at), bool)

    return code


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def _extents(found: DataFrame, window: int, probe: int) -> DataFrame:
    """A row for each stretch that was hit: its class, its number of starts, the bytes of their windows, and where it starts. The bytes come once for each different stretch of a task, or now and then again."""
    names = ["doc_id", "key", "start", "class", "digest", "starts", "size", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        sent: set[bytes] = set()
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                i, key, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py().encode()
                codes, start, stop = stretches_of(text, probe)
                use = np.isin(start, batch.column(3)[k].values.to_numpy(zero_copy_only=False))
                for c, s, e in zip(codes[use].view(np.int64).tolist(), start[use].tolist(), stop[use].tolist(), strict=True):
                    body = text[s : e + window]
                    digest = xxhash.xxh3_128_digest(body, e - s)
                    name = digest + c.to_bytes(8, signed=True)
                    if again := name in sent:
                        rows.append((i, key, s, c, digest, e - s + 1, len(body), None))
                    else:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(name)
                        rows.append((i, key, s, c, digest, e - s + 1, len(body), body))
                    size += 64 if again else len(body)
                    if size > BODY_BATCH:
                        yield _batch(rows, names, kinds)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, names, kinds)

    return found.mapInArrow(run, "doc_id long, key long, start int, class long, digest binary, starts int, size int, body binary")


def _runs(at: np.ndarray) -> np.ndarray:
    """First and last of each run of adjacent numbers, one behind the other."""
    if not len(at):
        return np.zeros(0, np.int32)
    cut = np.flatnonzero(np.diff(at) != 1)
    return np.stack([at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]], axis=1).ravel().astype(np.int32)


def _repeats_in(bodies: list[bytes], starts: list[int], widths: tuple[int, int]) -> list[list[np.ndarray]]:
    """For each width and body the runs of starts whose strings of that width start elsewhere in the bodies too: adjacent suffixes are compared."""
    lengths = np.array([len(b) + 1 for b in bodies])
    text = np.frombuffer(b"".join(b + b"\0" for b in bodies), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(lengths)
    text[ends - 1] = 0
    begins = ends - lengths
    order = suffix_array(text)
    local = np.arange(len(text)) - np.repeat(begins, lengths)
    order = order[(local < np.repeat(starts, lengths))[order]]
    left = (np.repeat(lengths, lengths) - 1 - local)[order]  # bytes of the body from there on
    raw, values = text.astype(np.uint16), np.concatenate([np.zeros(1, np.uint64), _BYTE_VALUES])[text]
    out = []
    for width in widths:
        own = order[left >= width]
        again = np.zeros(len(text), bool)
        if len(own) > 1:
            codes = rolled_at(values, width, own)
            near = np.flatnonzero(codes[1:] == codes[:-1])
            views = np.lib.stride_tricks.sliding_window_view(raw, width)
            for k in range(0, len(near), 4096):
                a, b = own[near[k : k + 4096]], own[near[k : k + 4096] + 1]
                same = (views[a] == views[b]).all(axis=1)
                again[a[same]] = again[b[same]] = True
        out.append([_runs(np.flatnonzero(again[s:e])) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)])
    return out


def _distinct_repeats(extents: DataFrame, window: int, probe: int) -> DataFrame:
    """(class, digest, long_runs, short_runs) of stretches: starts whose window, or probe, starts elsewhere too.

    A body that stands at several places repeats whole. Others are looked up in their
    class: by suffix sorting, or, where a class is too large for a task, by counting the
    128-bit hashes of its windows over all tasks.
    """
    runs = lambda last: F.when(last >= 0, F.array(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    places = extents.groupBy("class", "digest").agg(F.first("starts").alias("starts"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    whole = places.where("n > 1").select("class", "digest", runs(F.least(F.col("starts") - 1, F.col("size") - window)).alias("long_runs"), runs(F.col("starts") - 1).alias("short_runs"))
    mixed = places.groupBy("class").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("size").cast("long")).alias("total"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    sizes = materialise(mixed.select("class", "total"))
    release(extents.sparkSession)
    # dealt by class before the join: whatever join is chosen, a class stays in one task. Tasks have sent a body once, so few come twice
    dealt = extents.where("body is not null").select("class", "digest", "starts", "body").repartition("class")
    shared = lambda some: dealt.join(sizes.where(some).select("class"), "class").select("class", "digest", "starts", "body")
    names, kinds = ["class", "digest", "long_runs", "short_runs"], [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, bytes]] = []

        def done(rows: list[tuple[int, bytes, int, bytes]]) -> pa.RecordBatch:
            found = _repeats_in([r[3] for r in rows], [r[2] for r in rows], (window, probe))
            return _batch([(c, d, x, y) for (c, d, _, _), x, y in zip(rows, *found, strict=True) if len(y)], names, kinds)

        held_bytes = 0
        own: set[bytes] = set()  # digests of the class
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a class stays whole; several small ones are sorted together
                if held and row[0] != held[-1][0]:
                    own.clear()
                    if held_bytes > SORTED_BYTES:
                        yield done(held)
                        held, held_bytes = [], 0
                if row[1] in own:
                    continue
                own.add(row[1])
                held.append(row)
                held_bytes += len(row[3]) + 1
        if held:
            yield done(held)

    sorted_ = shared(F.col("total") <= LARGE_CLASS).sortWithinPartitions("class").mapInArrow(run, "class long, digest binary, long_runs array<int>, short_runs array<int>")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c, digest, starts, body = (col[k].as_py() for col in batch.columns)
                raw = np.frombuffer(body, np.uint8)
                for width in (window, probe):
                    at = np.arange(min(starts, len(body) - width + 1))
                    if len(at):
                        cols = [rolled_at(v[raw], width, at).view(np.int64) for v in (_BYTE_VALUES, _OTHER_VALUES)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([width] * len(at), pa.int32()), *map(pa.array, cols), pa.array([c] * len(at), pa.int64()), pa.array([digest] * len(at), pa.binary()), pa.array(at, pa.int32())], ["width", "a", "b", "class", "digest", "at"]
                        )

    found = whole.unionAll(sorted_)
    if sizes.where(F.col("total") > LARGE_CLASS).isEmpty():
        return found
    large = shared(F.col("total") > LARGE_CLASS).dropDuplicates(["class", "digest"]).repartition("digest").mapInArrow(hashes, "width int, a long, b long, class long, digest binary, at int")
    again = large.groupBy("width", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("width", "a", "b")
    at = lambda width: F.flatten(F.collect_list(F.when(F.col("width") == width, F.array("at", "at"))))
    counted = large.join(again, ["width", "a", "b"]).groupBy("class", "digest").agg(at(window).alias("long_runs"), at(probe).alias("short_runs"))
    return found.unionAll(counted)  # a body may come twice; runs that overlap do no harm


def _covered(runs: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n bytes lie under a string of that width whose start is in one of the runs."""
    pairs = runs.reshape(-1, 2).astype(np.int64)
    edge = np.bincount(pairs[:, 0], minlength=n + 1) - np.bincount(pairs[:, 1] + width, minlength=n + 1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeated_bytes(docs: DataFrame, window: int = 400, probe: int = PROBE, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated and, if asked for, kept (bytes) for every row of docs.

    A byte goes if a string of window bytes over it starts anywhere else too, judged on
    the UTF-8 of the input. n_repeated counts the bytes under a string of probe bytes that
    starts anywhere else too: repeats that are too short to be removed show there.

    Each string of probe bytes has an anchor, the leftmost smallest of its grams, so equal
    strings have equal anchors. An anchor with the half of the string that lies beside it
    names a class; classes of a single stretch are left out, and the others are what
    suffix sorting is distributed by. Equal stretches are collapsed to one before, with the
    fact that they repeat; so are documents with equal text. Suffixes of one class meet in
    one task, are sorted by the difference cover, and neighbours in that order are
    compared over window and probe bytes. A class that is too large for a task is spread
    window by window instead.

    Null text is empty; texts under probe bytes lose nothing and have no repeats; rows
    alike in id and text are documents of their own, and so are rows with a null id. doc_id
    is an integer. Other columns are not read. An empty table gives an empty result.
    """
    probe = min(probe, window)
    keyed = keyed_documents(docs)
    body = F.col("text").cast("binary")
    rows = keyed.select("doc_id", "key", F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("whole_sha256"))
    groups = rows.groupBy("whole_sha256").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "key")).alias("stays"))
    base = materialise(rows.join(groups, "whole_sha256"))
    written = materialise(meeting_positions(keyed, stretch_coder(probe), anchored=False))
    release(docs.sparkSession)
    # one document of each group of copies stands for all
    lone = base.where(F.struct("doc_id", "key") == F.col("stays")).select("doc_id", "key").dropDuplicates()
    hits = written.join(lone, ["doc_id", "key"])
    found = keyed.join(hits, ["doc_id", "key"]).select("doc_id", "key", "text", "hits").dropDuplicates(["doc_id", "key"])
    extents = materialise(_extents(found, window, probe))
    discard(written)
    release(docs.sparkSession)
    runs = materialise(_distinct_repeats(extents, window, probe))
    release(docs.sparkSession)
    single = base.where("copies = 1").select("doc_id", "key")  # in a group of copies all goes anyway
    placed = extents.select("doc_id", "key", "start", "class", "digest").join(runs, ["class", "digest"]).join(single, ["doc_id", "key"], "left_semi")
    moved = lambda c: F.flatten(F.collect_list(F.transform(c, lambda s: s + F.col("start")))).alias(c)
    starts = materialise(placed.groupBy("doc_id", "key").agg(moved("long_runs"), moved("short_runs")))
    discard(extents)
    discard(runs)
    release(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            out: list[tuple] = []
            for k in range(batch.num_rows):
                text = np.frombuffer(batch.column(2)[k].as_py().encode(), np.uint8)
                gone, again = (_covered(batch.column(c)[k].values.to_numpy(zero_copy_only=False), w, len(text)) for c, w in ((3, window), (4, probe)))
                kept = text[~gone].tobytes()
                spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) > 0).sum())
                out.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), int(again.sum()), *([kept] if with_text else [])))
            yield _batch(out, names, kinds)

    names = ["doc_id", "key", "cut_removed", "cut_spans", "cut_sha256", "cut_repeated", *(["cut"] if with_text else [])]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), *([pa.binary()] if with_text else [])]
    touched = keyed.join(starts, ["doc_id", "key"]).select("doc_id", "key", "text", "long_runs", "short_runs")
    shorter = touched.mapInArrow(cut, "doc_id long, key long, cut_removed long, cut_spans long, cut_sha256 string, cut_repeated long" + (", cut binary" if with_text else ""))
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    both = base.join(shorter, ["doc_id", "key"], "left")
    if with_text:
        both = both.join(keyed.select("doc_id", "key", body.alias("_body")).dropDuplicates(["doc_id", "key"]), ["doc_id", "key"])
    nothing = hashlib.sha256(b"").hexdigest()
    return both.select(
        real_id("doc_id"),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("cut_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("cut_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(nothing)).otherwise(F.coalesce("cut_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when((F.col("copies") > 1) & (F.col("n_bytes") >= probe), F.col("n_bytes")).otherwise(F.coalesce("cut_repeated", F.lit(0))).cast("long").alias("n_repeated"),
        *([F.when(gone, F.lit(b"")).otherwise(F.coalesce("cut", "_body")).alias("kept")] if with_text else []),
    )
