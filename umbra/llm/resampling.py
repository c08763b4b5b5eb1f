"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import Memo, id_and_text, materialise, sliced, with_global_rank

HALF = 1 << 15  # buckets of single tokens; as many again for pairs
TOKENS = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")
LEAN = 500  # tokens' worth of the raw model that the model of each kind leans on
STRETCH = 24  # tokens of a stretch that toxic text may fill
SUPPORT = 0.03  # share of the toxic documents that hold a token which the toxic model prefers, so that groups of copies don't fill it with their rare words
FEWEST = 5  # toxic documents that hold it at least, whatever their share
LIFT = 4  # times that such a token is as frequent among them at least


class _Buckets(Memo):
    def __missing__(self, token: bytes) -> int:
        return self.put(token, xxhash.xxh32_intdigest(token), 170 + len(token))


_memo = _Buckets("resampling", 32_000_000)


def features(text: str) -> np.ndarray:
    """Bucket of each token and of each two adjacent tokens (from HALF on), repeats included."""
    return _features(TOKENS.findall(text.encode()))


def _features(tokens: list[bytes]) -> np.ndarray:
    one = np.fromiter(map(_memo.__getitem__, tokens), np.uint64, len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(49)
    two[one[:-1] == one[1:]] = HALF - 1  # a token behind itself, whichever it is
    return np.concatenate([one & np.uint64(HALF - 1), two + np.uint64(HALF)]).astype(np.int64)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, good and toxic (0 or 1) of every row of docs; null where it has no label. Rows with a null id have none and stay out of the join."""
    have = {c.lower() for c in labels.columns}
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in have else F.lit(0)
    slim = id_and_text(docs)
    one = labels.select(F.col("doc_id").try_cast(slim.schema["doc_id"].dataType).alias("_label_id"), "quality", toxic.alias("toxic")).where("_label_id is not null and quality is not null")
    known = one.groupBy("_label_id").agg((F.min("quality") > 0).cast("int").alias("good"), (F.max("toxic") > 0).cast("int").alias("toxic"))
    # a merge join at any size, so that what a small run writes tells what a large one will
    named = slim.where("doc_id is not null").join(known.hint("merge"), F.col("doc_id") == F.col("_label_id"), "left").select("text", "good", "toxic")
    return named.unionAll(slim.where("doc_id is null").select("text", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic")))


TARGET, JUNK, TOXIC = range(3)


def _kind(good: int, toxic: int) -> int:
    """Documents that are good but for toxic stretches are a kind of their own."""
    return JUNK if not good else TOXIC if toxic else TARGET


class Model:
    """Hashed n-gram models of target and raw text.

    The raw model is a mixture of three kinds of document, weighted as among the labelled
    ones: target; junk, all of whose tokens are drawn from a model of its own; and target
    text of which one stretch, anywhere, is drawn from a toxic model.
    """

    def __init__(self, counts: np.ndarray, held: np.ndarray, documents: np.ndarray):
        """counts: raw, target and junk tokens by bucket; held: other and toxic documents by bucket; documents: of each kind."""
        raw, target, junk = counts.astype(float)
        self.junk = np.zeros(2 * HALF)  # log ratio of junk to target by bucket
        for h in (slice(0, HALF), slice(HALF, 2 * HALF)):
            base = (raw[h] + 0.5) / (raw[h].sum() + 0.5 * HALF)
            share = [np.log((c[h] + LEAN * base) / (c[h].sum() + LEAN)) for c in (target, junk)]
            self.junk[h] = share[1] - share[0]
        other, toxic = held.astype(float)
        lift = np.log((toxic + 0.1) / (documents[TOXIC] + 0.2)) - np.log((other + 0.5) / (documents[TARGET] + documents[JUNK] + 1))
        self.toxic = np.where((toxic >= max(FEWEST, SUPPORT * documents[TOXIC])) & (lift >= math.log(LIFT)), lift, 0.0)
        prior = documents + np.array([2.0, 0.5, 0.5])
        self.prior = np.log(prior / prior.sum())

    def ratios(self, found: np.ndarray) -> tuple[float, float, float]:
        """Log ratios: of target to raw text, of junk to target, and of text with a toxic stretch to target."""
        junk = float(self.junk[found].sum())
        sums = np.concatenate([[0.0], np.cumsum(self.toxic[found[: (len(found) + 1) // 2]])])
        width = min(STRETCH, len(sums) - 1)
        stretches = sums[width:] - sums[: len(sums) - width] if width else sums
        most = stretches.max()
        toxic = float(most + np.log(np.exp(stretches - most).mean()))
        return -float(np.logaddexp.reduce(self.prior + [0.0, junk, toxic])), junk, toxic


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Raw counts over all documents; counts of the kinds over all labelled ones, which a join tells: nothing that grows is sent to tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, documents = np.zeros((3, 2 * HALF), np.int64), np.zeros((2, HALF), np.int64), np.zeros(3, np.int64)
        waiting: list[list[np.ndarray]] = [[], [], []]  # of all, target and junk
        Memo.enter("resampling")

        def add() -> None:
            for row, own in zip(total, waiting, strict=True):
                if own:
                    row += np.bincount(np.concatenate(own), minlength=2 * HALF)
                    own.clear()

        for batch in sliced(batches, 0):
            for text, good, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = features(text)
                waiting[0].append(found)
                if good is not None:
                    kind = _kind(good, toxic)
                    documents[kind] += 1
                    if kind != TOXIC:
                        waiting[1 + kind].append(found)
                    held[int(kind == TOXIC), np.unique(found[: (len(found) + 1) // 2])] += 1
                if len(found) > 1 << 16 or len(waiting[0]) >= 512:
                    add()
        add()
        at = np.flatnonzero(total[0])
        both = np.concatenate([held, np.zeros_like(held)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c[at]) for c in (*total, *both))], names)
        kinds = np.arange(3)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - kinds), pa.array(documents), *(pa.array(0 * kinds) for _ in range(4))], names)

    names = ["bucket", "raw", "target", "junk", "other", "toxic"]
    sums = _labelled(docs, labels).mapInArrow(count, ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names[1:]])
    counts, held, documents = np.zeros((3, 2 * HALF), np.int64), np.zeros((2, HALF), np.int64), np.zeros(3)
    for r in sums.collect():  # one row for each bucket at most
        if r["bucket"] < 0:
            documents[-1 - r["bucket"]] = r["raw"]
            continue
        counts[:, r["bucket"]] = r["raw"], r["target"], r["junk"]
        if r["bucket"] < HALF:
            held[:, r["bucket"]] = r["other"], r["toxic"]
    return Model(counts, held, documents)


def importance_resample(docs: DataFrame, labels: DataFrame, seed: int = 17, temperature: float = 0.05) -> DataFrame:
    """doc_id, log_ratio, n_features, junk_ratio, toxic_ratio and kept for every row of docs.

    log_ratio is the log importance weight of the text: the ratio of the hashed n-gram
    models of target (labelled good and not toxic) and raw text, see Model. k, the number
    of documents more likely of the target than not under the raw mixture, is counted
    over all rows; the k largest of log_ratio / temperature plus Gumbel noise (from the id
    and seed, so a rerun draws alike) are kept, which samples k rows without replacement in
    proportion to their importance to the power 1 / temperature: a low one keeps nearly
    all clean documents, 1 samples in proportion to the ratio itself. Ranks come from a
    range shuffle of narrow rows.

    Null text counts as empty and has no features: its ratio is that of the prior.
    Repeated rows get equal scores and are drawn alike, ties by order. Rows with a null id
    are scored like any other. All labelled rows count; of several labels of one id the
    smallest quality and the largest toxic do. Without labels every row is kept. Columns other than
    doc_id and text are not read. An empty table gives an empty result.
    """
    model = fit(docs, labels)
    slim = id_and_text(docs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.enter("resampling")
        for batch in sliced(batches):
            found = [features(t) for t in batch.column(1).to_pylist()]
            ratio, junk, toxic = np.array([model.ratios(f) for f in found]).T
            u = np.array([(xxhash.xxh64_intdigest(str(i), seed) + 0.5) / 2**64 for i in batch.column(0).to_pylist()])
            drawn = ratio / temperature - np.log(-np.log(u))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ratio), pa.array([len(f) for f in found], pa.int64()), pa.array(junk), pa.array(toxic), pa.array(-drawn), pa.array(ratio + model.prior[TARGET] >= math.log(0.5))],
                ["doc_id", "log_ratio", "n_features", "junk_ratio", "toxic_ratio", "draw", "likely"],
            )

    kind = slim.schema["doc_id"].dataType.simpleString()
    # written out, since a range shuffle reads its input twice
    scored = materialise(slim.mapInArrow(score, f"doc_id {kind}, log_ratio double, n_features long, junk_ratio double, toxic_ratio double, draw double, likely boolean"))
    k = scored.agg(F.sum(F.col("likely").cast("long"))).first()[0] or 0
    ranked = with_global_rank(scored, ["draw", "doc_id"])
    return ranked.select("doc_id", "log_ratio", "n_features", "junk_ratio", "toxic_ratio", (F.col("rank") < F.lit(k)).alias("kept"))


def keep_resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that importance_resample keeps, all columns as they were."""
    kept = importance_resample(docs, labels).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
