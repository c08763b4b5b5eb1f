"""Substring dedup: fixed-block anchors, probed with every rolling window and extended to exact repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import Memo, materialise, sliced
from umbra.llm.exchange import meeting_positions, rolling

class _Symbols(Memo):
    """Word -> a 64-bit value."""

    def __missing__(self, word: bytes) -> int:
        return self.put(word, xxhash.xxh64_intdigest(word, 91), 180 + len(word))


_memo = _Symbols("anchors", 48_000_000)


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, 64-bit value of each word of all)."""
    parts, lengths = [], []
    for text in texts:
        words = text.split()
        lengths.append(len(words))
        parts.append(np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words)))
    return np.array(lengths, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _inside(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the concatenation from which width words lie in one text, the same counted in the text)."""
    n = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    local = np.arange(n) - np.repeat(starts, lengths)
    good = local + width <= np.repeat(lengths, lengths)
    return np.flatnonzero(good), local[good]


def block_coder(block: int):
    """Codes of all rolling windows of block words; those that are reference blocks are flagged."""

    def code(texts: list[bytes], _: list):
        lengths, symbols = _symbols(texts)
        at, local = _inside(lengths, block)
        return lengths, at, rolling(symbols, block)[at], local % block == 0

    return code


def window_coder(window: int, block: int):
    """Codes of the windows that hold an anchor: a hit at t is extended over every window with words t to t + block - 1."""

    def code(texts: list[bytes], hits: list):
        lengths, symbols = _symbols(texts)
        at, local = _inside(lengths, window)
        reach = np.zeros(int(lengths.sum()) + 1, np.int64)
        starts = np.cumsum(lengths) - lengths
        for s, own in zip(starts.tolist(), hits, strict=True):
            own = np.asarray(own, np.int64)
            np.add.at(reach, s + np.maximum(own - (window - block), 0), 1)
            np.add.at(reach, s + own + 1, -1)
        held = np.cumsum(reach)[at] > 0
        codes = rolling(symbols, window)[at[held]]
        return lengths, at[held], codes, np.zeros(len(codes), bool)

    return code


NO_ID = -(1 << 63)  # stands for a null id on the way


def keyed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text to tell rows of one id apart, and the text with null as empty."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("text"))


def real_id(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)


def repeated_windows(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, key, hits): starts of the windows of that many words whose sequence starts anywhere else too.

    Reference blocks are the non-overlapping runs of (window + 1) // 2 words from the
    start of each document: any window holds one whole. Every rolling window of that
    width probes them, its own block aside. A hit is extended by the words round it:
    the windows over it are compared whole, by a 64-bit hash and a bucket, so a hit
    grows to the maximal exact repeat and a chance hit goes.
    """
    block = (window + 1) // 2
    keyed = keyed_documents(docs)
    hits = materialise(meeting_positions(keyed, block_coder(block), anchored=True))
    found = keyed.join(hits, ["doc_id", "key"]).select("doc_id", "key", "text", "hits")
    return materialise(meeting_positions(found, window_coder(window, block), anchored=False))


def _cover(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge)[:n] > 0


def remove_repeats(docs: DataFrame, window: int = 35, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept for every row of docs.

    Every word covered by a repeated window goes; windows are judged on the input. Words
    are runs of other than ASCII white space, unchanged; kept words are joined by one
    space. A hot passage costs a few bytes for each place it stands at, spread over the
    buckets of its windows; no pairs are formed.

    Null text has no words. Rows alike in id and text count as documents of their own,
    so all their windows repeat; so do rows with a null id. doc_id is an integer. Other columns are not read. An
    empty table gives an empty result.
    """
    keyed = keyed_documents(docs)
    starts = repeated_windows(docs, window)
    kept_type = ", kept string" if with_text else ""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            split = [t.encode().split() for t in batch.column(2).to_pylist()]
            lines = [b" ".join(w) for w in split]
            cols = [batch.column(0), batch.column(1), pa.array([len(w) for w in split], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in lines], pa.string())]
            names = ["doc_id", "key", "n_words", "kept_sha256"]
            if with_text:
                cols.append(pa.array([s.decode() for s in lines], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            removed, digests, texts = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                words = text.encode().split()
                gone = _cover(batch.column(3)[k].values.to_numpy(zero_copy_only=False).astype(np.int64), window, len(words))
                line = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(line).hexdigest())
                texts.append(line.decode())
            cols = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "key", "n_removed", "cut_sha256"]
            if with_text:
                cols.append(pa.array(texts, pa.string()))
                names.append("cut")
            yield pa.RecordBatch.from_arrays(cols, names)

    plain = keyed.mapInArrow(whole, f"doc_id long, key long, n_words long, kept_sha256 string{kept_type}")
    touched = keyed.join(starts, ["doc_id", "key"]).select("doc_id", "key", "text", "hits").dropDuplicates(["doc_id", "key"])
    shorter = touched.mapInArrow(cut, f"doc_id long, key long, n_removed long, cut_sha256 string{', cut string' if with_text else ''}")
    both = plain.join(shorter, ["doc_id", "key"], "left")
    return both.select(
        real_id("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"), *([F.coalesce("cut", "kept").alias("kept")] if with_text else [])
    )
