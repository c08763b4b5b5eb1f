"""LM scoring: a gated recurrent language model in numpy with a class-factored softmax."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.llm.common import Memo, materialise, settle, sliced

END = b"\n"  # no word holds white space
HEAD = 131_072  # bound on the frequent words whose counts every task gets; the others are looked up by a join
SOFT = 2_048  # most frequent words that the network tells apart
CLASSES = 32  # of those words; the others are in classes by frequency, each double the one before
TAILS = 64  # inputs for all other words, by their last bytes
HIDDEN = 16
STEPS = 16  # length of truncated backpropagation
LANES = 512
FLUSH = 250_000
BLOCK = 1_024  # rows of scores worked on at once, so that they stay in the cache
PIECE = 16_384  # weights that are changed at once, so that they stay in the cache
POOL = 32_768  # states, at least, whose outputs are worked out together, be they of many documents or of many steps
CHUNK = LANES * STEPS * 40  # tokens, at least, that are cut in lanes together
ROUNDS = (0.125, 1.0)  # shares of the training documents, by id hash, up to which each averaging round goes
GATHER = 16  # rows in which the weights of all tasks come to the driver

Weights = dict[str, np.ndarray]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def bytes_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 of a text column, without a detour by str."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the text with null as empty."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return docs.select(F.col("doc_id"), held.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) over all training tokens, the end of each document included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(counts.items())
            for k in range(0, len(items), 50_000):
                part = items[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], ["word", "c"])

        Memo.enter("gru")
        for batch in sliced(batches, 0):
            for text in bytes_of(batch.column(0)):
                counts.update(words_of(text))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield from out()
                    counts.clear()
        yield from out()
        counts.clear()
        settle()

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most HEAD words with their counts, by falling count: all above a count that a small histogram tells, and of the bin that it cuts as many as there is room for, chosen by hash."""
    bins = F.when(F.col("c") < 64, F.col("c")).otherwise(F.floor(F.log2("c") * 16)).cast("int")  # 63 is below log2(64) * 16
    sizes = counts.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low")).collect()  # some 1,000 rows at most
    low, share, room = 0, 1.0, HEAD
    for r in sorted(sizes, key=lambda r: -r["low"]):
        if r["n"] > room:
            low, share = r["low"], room / r["n"]
            break
        room -= r["n"]
    chosen = counts.where(F.col("c") >= low)
    if share < 1:
        cut = next(r["bin"] for r in sizes if r["low"] == low)
        chosen = chosen.where((bins != cut) | (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.lit(int(0.98 * share * (1 << 30)))))
    rows = chosen.toArrow()
    return sorted(zip(rows["word"].to_pylist(), rows["c"].to_pylist(), strict=True), key=lambda wc: (-wc[1], wc[0]))[:HEAD]


@dataclass
class Vocabulary:
    """The head words by falling count, and the totals over all words.

    The first words are soft: the network tells them apart. The others are in bands by
    rank, each double the one before, and what is outside the head in a last one. In
    a band a word has its smoothed share of the counts, so every word has a chance.
    """

    head: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    distinct: int

    @property
    def soft(self) -> int:
        return min(SOFT, len(self.counts))

    @property
    def size(self) -> int:
        """Words in a class."""
        return math.ceil(max(self.soft, 1) / CLASSES)

    def band_edges(self) -> list[int]:
        """First ranks of the bands inside the head, and its end."""
        edges = [self.soft]
        while edges[-1] < len(self.counts):
            edges.append(min(2 * edges[-1], len(self.counts)))
        return edges

    @property
    def bands(self) -> int:
        return len(self.band_edges())

    def band_logs(self) -> np.ndarray:
        """log10 of what a word's smoothed count is divided by in each band."""
        edges = self.band_edges()
        own = [(int(self.counts[s:e].sum()), e - s) for s, e in zip(edges, edges[1:], strict=False)]
        own.append((self.tokens - int(self.counts.sum()), self.distinct - len(self.counts) + 1))
        return np.array([math.log10(c + 0.1 * n) for c, n in own])

    @property
    def base_log(self) -> float:
        return math.log10(self.tokens + 0.1 * (self.distinct + 1))

    def codes(self) -> Codes:
        return Codes(self.head)

    def inputs(self) -> np.ndarray:
        """Network input of each code: soft words as they are, others by a hash of their last bytes."""
        out = np.empty(HEAD + TAILS, np.int32)
        out[HEAD:] = SOFT + np.arange(TAILS)
        for w, k in self.head.items():
            out[k] = k if k < self.soft else SOFT + _tail(w)
        return out

    def targets(self) -> np.ndarray:
        """What the network is to tell for each code: a soft word, or soft plus a band."""
        out = np.full(HEAD + TAILS, self.soft + self.bands - 1, np.int32)
        out[: self.soft] = np.arange(self.soft)
        edges = self.band_edges()
        for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
            out[s:e] = self.soft + k
        return out


@dataclass
class Pairs:
    """Numbers of two bytes for what the network takes in and is to tell of a word: a soft word has its own, others one for each input and band. Texts are looked up once and go through all rounds as these."""

    x: np.ndarray  # number -> input
    y: np.ndarray  # number -> target

    @classmethod
    def of(cls, v: Vocabulary) -> Pairs:
        x = np.concatenate([np.arange(SOFT), SOFT + np.repeat(np.arange(TAILS), v.bands)])
        y = np.concatenate([np.minimum(np.arange(SOFT), max(v.soft - 1, 0)), v.soft + np.tile(np.arange(v.bands), TAILS)])
        return cls(x.astype(np.int16), y.astype(np.int16))

    @staticmethod
    def numbers(v: Vocabulary) -> np.ndarray:
        """Number of each code."""
        x, y = v.inputs(), v.targets()
        return np.where(y < v.soft, y, SOFT + (x - SOFT) * v.bands + (y - v.soft)).astype(np.uint16)

    def read(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, targets, number of tokens of each document) of documents behind one another, each with its end."""
        own = np.frombuffer(b"".join(raw), np.uint16)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
        x = np.empty(len(own), np.int16)
        x[1:] = self.x[own[:-1]]
        x[np.cumsum(lengths) - lengths] = START
        return x, self.y[own], lengths


def _tail(word: bytes) -> int:
    return (word[-1] * 7 + (word[-2] if len(word) > 1 else 0)) % TAILS


class Codes(dict):
    """Word -> its number in the head, or HEAD plus a hash of its last bytes."""

    def __missing__(self, word: bytes) -> int:
        return HEAD + _tail(word)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


class Room(dict):
    """Arrays that are filled again and again: the pages of a fresh large array cost more than the sums that go into it."""

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size, held = math.prod(shape), self.get(name)
        if held is None or held.size < size or held.dtype != kind:
            held = self[name] = np.empty(size, kind)
        return held[:size].reshape(shape)


START = SOFT + TAILS
TINY = np.float32(np.finfo(np.float32).tiny)


def fresh_weights(v: Vocabulary, seed: int = 5) -> Weights:
    """Output biases give the unigram distribution, so training starts from the base model."""
    r = np.random.default_rng(seed)
    size, soft = v.size, v.soft
    counts = np.zeros(CLASSES * size)
    counts[:soft] = v.counts[:soft]
    per_class = np.concatenate([counts.reshape(CLASSES, size).sum(axis=1) + 0.1, 10 ** v.band_logs()])
    filled = np.concatenate([np.arange(CLASSES) * size < soft, np.ones(v.bands, bool)])  # classes without words have no share
    inner = np.where(np.arange(CLASSES * size) < soft, np.log(counts + 0.1), -1e4).reshape(CLASSES, size)
    inner -= inner.max(axis=1, keepdims=True)
    return {
        "in": _planes(r.standard_normal((START + 1, 3 * HIDDEN)) * 0.3),
        "rec": _planes(r.standard_normal((HIDDEN, 3 * HIDDEN)) / math.sqrt(HIDDEN)),
        "class": np.zeros((HIDDEN, CLASSES + v.bands), np.float32),
        "class_bias": np.where(filled, np.log(per_class / per_class[filled].sum()), -1e4).astype(np.float32),
        "word": np.zeros((CLASSES, HIDDEN, size), np.float32),
        "word_bias": inner.astype(np.float32),
    }


def _planes(gates: np.ndarray) -> np.ndarray:
    """(3, rows, HIDDEN): a plane for each gate, so that what is done to one gate runs over memory in one piece."""
    return np.ascontiguousarray(gates.reshape(-1, 3, HIDDEN).transpose(1, 0, 2), np.float32)


def step(w: Weights, x: np.ndarray, h: np.ndarray, gates: np.ndarray, inner: np.ndarray, fresh: np.ndarray, out: np.ndarray) -> None:
    """One gated step from state h into out; gates (two planes), inner and fresh get what backpropagation needs. The logistic function is a shifted tanh."""
    gates = gates.reshape(2, len(x), HIDDEN)
    a = np.take(w["in"], x, axis=1)
    np.matmul(h, w["rec"][:2], out=gates)
    gates += a[:2]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    np.matmul(h, w["rec"][2], out=inner)
    np.multiply(gates[1], inner, out=fresh)
    fresh += a[2]
    np.tanh(fresh, out=fresh)
    np.subtract(h, fresh, out=out)
    out *= gates[0]
    out += fresh


def _log_softmax(h: np.ndarray, w: np.ndarray, target: np.ndarray, ones: np.ndarray, learning: bool, room: Room) -> tuple[np.ndarray, np.ndarray | None]:
    """(natural log share of each target among the scores h w, gradient of those scores). Scores start as log shares and stay small; where one doesn't, a bound keeps them finite."""
    scores = room("scores", (len(h), w.shape[1]), h.dtype)
    np.matmul(h, w, out=scores)
    at = np.arange(0, scores.size, scores.shape[1])
    at += target
    logs = scores.ravel()[at]
    np.exp(scores, out=scores)
    total = scores @ ones
    if not total.max() < np.inf:
        np.minimum(h @ w, 60, out=scores)
        logs = scores.ravel()[at]
        np.exp(scores, out=scores)
        total = scores @ ones
    np.maximum(total, TINY, out=total)
    logs -= np.log(total)
    if not learning:
        return logs, None
    scores *= (1 / total)[:, None]
    scores.ravel()[at] -= 1
    return logs, scores


def outputs(w: Weights, h: np.ndarray, y: np.ndarray, soft: int, grad: Weights | None = None, room: Room | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(natural log probability of each target, gradient for h). A target from soft on stands for a band."""
    room = Room() if room is None else room
    size = w["word"].shape[2]
    group = np.where(y < soft, y // size, y + (CLASSES - soft))
    order = np.argsort(group.astype(np.uint8), kind="stable")
    y, group = y[order], group[order]  # class by class
    bounds = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    logs, learning = np.empty(len(y)), grad is not None
    one = room("one", (len(y), HIDDEN + 1), h.dtype)  # biases are the weights of a last unit that is always one
    one[:, HIDDEN] = 1
    one[:, :HIDDEN] = np.take(h, order, axis=0, out=room("ordered", h.shape, h.dtype), mode="clip")
    to_class, to_word = np.vstack([w["class"], w["class_bias"]]), np.concatenate([w["word"], w["word_bias"][:, None]], axis=1)
    of_class, of_word = np.ones(to_class.shape[1], h.dtype), np.ones(size, h.dtype)
    back = room("back", h.shape, h.dtype) if learning else None
    with np.errstate(over="ignore"):
        for s in range(0, len(y), BLOCK):
            own = one[s : s + BLOCK]
            logs[s : s + BLOCK], e = _log_softmax(own, to_class, group[s : s + BLOCK], of_class, learning, room)
            if learning:
                g = own.T @ e
                grad["class"] += g[:HIDDEN]
                grad["class_bias"] += g[HIDDEN]
                np.matmul(e, w["class"].T, out=back[s : s + BLOCK])
        for c in range(CLASSES):
            for s in range(bounds[c], bounds[c + 1], BLOCK):
                t = min(s + BLOCK, bounds[c + 1])
                own = one[s:t]
                found, e = _log_softmax(own, to_word[c], y[s:t] - c * size, of_word, learning, room)
                logs[s:t] += found
                if learning:
                    g = own.T @ e
                    grad["word"][c] += g[:HIDDEN]
                    grad["word_bias"][c] += g[HIDDEN]
                    back[s:t] += e @ w["word"][c].T
    out = np.empty(len(y))
    out[order] = logs
    if back is not None:
        unsorted = room("unsorted", h.shape, h.dtype)
        unsorted[order] = back
        back = unsorted
    return out, back


def window_gradient(w: Weights, x: np.ndarray, y: np.ndarray, h: np.ndarray, soft: int, room: Room | None = None) -> tuple[Weights, np.ndarray, float]:
    """Truncated backpropagation over x, y of shape (steps, lanes) from state h: (gradient, last state, sum of logs). The gradient is in room's arrays."""
    room, kind, shape, plane = Room() if room is None else room, w["rec"].dtype, (*x.shape, HIDDEN), (x.size, HIDDEN)
    grad = {k: room("grad " + k, v.shape, kind) for k, v in w.items()}
    for g in grad.values():
        g.fill(0)
    alive = (x != START).astype(kind)[:, :, None]  # the state before a document's first word is zero
    gates = room("gates", (len(x), 2, *shape[1:]), kind)
    before, inner, n, states = (room(name, shape, kind) for name in ("before", "inner", "n", "states"))
    for t in range(len(x)):
        np.multiply(h, alive[t], out=before[t])
        step(w, x[t], before[t], gates[t], inner[t], n[t], states[t])
        h = states[t]
    logs, back = outputs(w, states.reshape(plane), y.reshape(-1), soft, grad, room)
    back = back.reshape(shape)
    through, news = room("through", (3, *shape), kind), room("news", shape, kind)  # gradients of what the state before adds, by gate, and of what the inputs add to the last, which is the one that differs
    back_rec, part = np.ascontiguousarray(w["rec"].transpose(0, 2, 1)), room("part", (3, *shape[1:]), kind)
    ahead, own = np.zeros_like(h), np.empty_like(h)
    for t in range(len(x) - 1, -1, -1):
        z, r = gates[t]
        d = back[t]
        d += ahead
        np.subtract(1, z, out=own)
        new = news[t]  # d (1 - z) (1 - n n)
        np.multiply(n[t], n[t], out=new)
        np.subtract(1, new, out=new)
        new *= own
        new *= d
        up = through[0, t]  # d (h - n) z (1 - z)
        np.subtract(before[t], n[t], out=up)
        up *= own
        up *= z
        up *= d
        again = through[1, t]  # new inner r (1 - r)
        np.subtract(1, r, out=again)
        again *= r
        again *= inner[t]
        again *= new
        np.multiply(new, r, out=through[2, t])
        np.matmul(through[:, t], back_rec, out=part)
        np.multiply(d, z, out=ahead)
        for k in range(3):
            ahead += part[k]
        ahead *= alive[t]
    grad["rec"] += before.reshape(plane).T @ through.reshape(3, *plane)
    ids = x.reshape(-1)
    order = np.argsort(ids.astype(np.int16), kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    twos = np.result_type(kind, np.complex64)  # sums of complex numbers are those of two columns at once
    for k, of_inputs in enumerate((through[0], through[1], news)):
        by_id = np.take(of_inputs.reshape(plane), order, axis=0, out=room("by id", plane, kind), mode="clip")
        grad["in"][k, ids[first]] = np.add.reduceat(by_id.view(twos), first, axis=0).view(kind)
    return grad, h.copy(), float(logs.sum())


class Trainer:
    """Adam on one task's documents."""

    def __init__(self, w: Weights, rate: float):
        self.w = {k: v.copy() for k, v in w.items()}
        self.rate, self.count = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.s = {k: np.zeros_like(v) for k, v in w.items()}
        self.spare, self.room = np.empty(PIECE, np.float32), Room()

    def update(self, grad: Weights, n: int) -> None:
        self.count += 1
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grad.values())) / n
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)) / n)
        rate = np.float32(self.rate * math.sqrt(1 - 0.99**self.count) / (1 - 0.9**self.count))
        for k, g in grad.items():
            for at in range(0, g.size, PIECE):
                self._step(*(v.reshape(-1)[at : at + PIECE] for v in (self.w[k], g, self.m[k], self.s[k])), self.spare[: min(PIECE, g.size - at)], scale, rate)

    @staticmethod
    def _step(w: np.ndarray, g: np.ndarray, m: np.ndarray, s: np.ndarray, room: np.ndarray, scale: np.float32, rate: np.float32) -> None:
        g *= scale
        np.subtract(g, m, out=room)
        room *= np.float32(0.1)
        m += room
        np.multiply(g, g, out=room)
        room -= s
        room *= np.float32(0.01)
        s += room
        np.sqrt(s, out=room)
        room += np.float32(1e-6)
        np.divide(m, room, out=room)
        room *= rate
        w -= room

    def learn(self, x: np.ndarray, y: np.ndarray, soft: int, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """x and y are the tokens of whole documents behind one another; they are cut in lanes that run side by side. What is left over runs behind in one if these are the last, and is given back otherwise, to be learned with the next."""
        while len(x) and (last or len(x) >= CHUNK):
            lanes = max(1, min(LANES, len(x) // (STEPS * 40)))
            length = len(x) // lanes
            a, b = (v[: lanes * length].reshape(lanes, length).T for v in (x, y))
            h = np.zeros((lanes, HIDDEN), np.float32)
            for t in range(0, length, STEPS):
                grad, h, _ = window_gradient(self.w, np.ascontiguousarray(a[t : t + STEPS]), np.ascontiguousarray(b[t : t + STEPS]), h, soft, self.room)
                self.update(grad, lanes * len(a[t : t + STEPS]))
            x, y = x[lanes * length :], y[lanes * length :]
        return x, y


def _pack(w: Weights) -> bytes:
    return np.concatenate([v.ravel() for v in w.values()]).astype(np.float32).tobytes()


def _unpack(raw: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = raw[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def train_round(train: DataFrame, w: Weights, pairs: Pairs, soft: int, rate: float) -> Weights:
    """Every task learns from all of its documents, given as numbers of pairs; weights are averaged by tokens, in two steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trainer(w, rate)
        Memo.enter("gru")
        xs, ys = [np.zeros(0, np.int16)], [np.zeros(0, np.int16)]
        held = total = 0
        for batch in sliced(batches, 0, CHUNK):
            x, y, _ = pairs.read(batch.column(0).to_pylist())
            xs.append(x)
            ys.append(y)
            held, total = held + len(x), total + len(x)
            if held >= CHUNK:
                x, y = own.learn(np.concatenate(xs), np.concatenate(ys), soft, last=False)
                xs, ys, held = [x], [y], len(x)
        own.learn(np.concatenate(xs), np.concatenate(ys), soft)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total]), pa.array([_pack(own.w)], pa.binary())], ["part", "tokens", "weights"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0
        for batch in batches:
            for n, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.float32).astype(np.float64) * n
                total = part if total is None else total + part
                tokens += n
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], ["tokens", "weights"])

    each = train.select("ids").mapInArrow(run, "part long, tokens long, weights binary")
    dealt = each.repartition(GATHER, "part").sortWithinPartitions("part").mapInArrow(add, "tokens long, weights binary")
    rows = dealt.collect()  # GATHER rows at most at the usual width
    if not rows:
        return w
    tokens = sum(r["tokens"] for r in rows)
    return _unpack(sum(np.frombuffer(r["weights"], np.float32).astype(np.float64) * (r["tokens"] / tokens) for r in sorted(rows, key=lambda r: (r["tokens"], bytes(r["weights"])))), w)


def document_logs(w: Weights, xs: list[np.ndarray], ys: list[np.ndarray], soft: int) -> np.ndarray:
    """Natural log probability of each document, soft words and classes only: the state is carried from its first word to its end."""
    if not xs:
        return np.zeros(0)
    order = np.argsort([-len(x) for x in xs], kind="stable")
    lengths = np.array([len(xs[k]) for k in order])
    x, y = np.concatenate([xs[k] for k in order]), np.concatenate([ys[k] for k in order])
    begins = np.cumsum(lengths) - lengths
    out = np.zeros(len(xs))
    h = np.zeros((len(xs), HIDDEN), np.float32)
    room, used = np.empty((4, len(xs) * HIDDEN), np.float32), Room()
    states, places, owners, pooled = [], [], [], 0
    now = len(xs)
    for s in range(int(lengths[0])):
        while lengths[now - 1] <= s:  # now is the number of documents longer than s
            now -= 1
        at = begins[:now] + s
        new = np.empty((now, HIDDEN), np.float32)
        step(w, x[at], h[:now], room[:2].reshape(-1)[: 2 * now * HIDDEN], room[2, : now * HIDDEN].reshape(now, HIDDEN), room[3, : now * HIDDEN].reshape(now, HIDDEN), new)
        h = new
        states.append(h)
        places.append(at)
        owners.append(np.arange(now))
        pooled += now
        if pooled >= POOL or s + 1 == lengths[0]:
            logs, _ = outputs(w, np.concatenate(states), y[np.concatenate(places)], soft, None, used)
            out += np.bincount(np.concatenate(owners), weights=logs, minlength=len(xs))
            states, places, owners, pooled = [], [], [], 0
    back = np.empty(len(xs))
    back[order] = out
    return back


def look_up(own: DataFrame, v: Vocabulary) -> DataFrame:
    """For each row the numbers of its words and its end as bytes (ids), what its words in the head bring to the scores, and its other words with how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        codes, numbers, targets = v.codes(), Pairs.numbers(v), v.targets()
        base, tail = np.zeros(len(targets)), np.zeros(len(targets))  # by code: log10 of the smoothed count, and of the share in the band for words that the network doesn't tell apart
        base[: len(v.counts)] = np.log10(v.counts + 0.1)
        tail[v.soft : len(v.counts)] = (base - v.band_logs()[np.maximum(targets - v.soft, 0)])[v.soft : len(v.counts)]
        Memo.enter("gru")
        for batch in sliced(batches, 2, 1_000_000):
            words: list[bytes] = []
            ends = []
            for text in bytes_of(batch.column(2)):
                words += words_of(text)
                words.append(END)
                ends.append(len(words))
            ids = codes.of(words)
            begins = np.array([0, *ends[:-1]])
            others = np.flatnonzero(ids >= len(v.counts))
            stops = np.searchsorted(others, ends)
            found = [words[k] for k in others.tolist()]
            rare = [Counter(found[a:b]) for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
            n = np.diff(ends, prepend=0)
            arrays = [
                pa.array(np.arange(first, first + len(n))), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(n - np.diff(stops, prepend=0), pa.int64()),
                pa.array(np.add.reduceat(base[ids], begins)), pa.array(np.add.reduceat(tail[ids], begins)), _cut(numbers[ids].tobytes(), 2 * np.array([0, *ends])),
                pa.array([list(c) for c in rare], pa.list_(pa.binary())), pa.array([list(c.values()) for c in rare], pa.list_(pa.int64())),
            ]
            first += len(n)
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["row", "doc_id", "held_out", "n_tokens", "n_head", "base_head", "tail_head", "ids", "rest", "times"]
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_head long, base_head double, tail_head double, ids binary, rest array<binary>, times array<long>")


def _cut(whole: bytes, bounds: np.ndarray) -> pa.Array:
    """A binary column of the pieces between bounds."""
    return pa.array([whole[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())


def score_documents(docs: DataFrame, unit_bytes: int = 6_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    Words are runs of other than ASCII white space with A-Z lower-cased, and an end.
    Documents whose CRC-32 of the id is a multiple of 10 are held out; counts come from
    all others, and so do the weights: in each round every task learns from its whole
    documents by truncated backpropagation, and the tasks' weights are averaged. So the
    weights depend on how the documents are dealt to tasks. The output goes through
    classes that cover all words: those of the SOFT most frequent words, told apart by
    the network, and bands of rarer ones, in which each word has its smoothed share of
    the counts. The HEAD most frequent words go to every task with their counts; of the
    others each row sends each word once with how often it has it, and the counts come by
    a join. Words are looked up once: training and scoring read the numbers written then,
    two bytes a token, and documents with unit_bytes of them are scored together. State is
    carried through the whole document.

    Null text has only an end. Repeated rows count each. A null doc_id is not held out.
    Without training tokens score and base_score are zero. Columns other than doc_id
    and text are not read. An empty table gives an empty result.
    """
    own = prepared(docs)
    counts = materialise(count_words(own.where(~F.col("held_out"))))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = frequent(counts)
    v = Vocabulary({word: k for k, (word, _) in enumerate(top)}, np.array([c for _, c in top], np.int64), total["n"], total["v"])
    looked_up = materialise(look_up(own, v))
    pairs, soft, w = Pairs.of(v), v.soft, None
    if v.tokens:
        w = fresh_weights(v)
        done = 0.0
        for k, upto in enumerate(ROUNDS):
            share = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1000)) / F.lit(1000.0)
            w = train_round(looked_up.where(~F.col("held_out") & (share >= done) & (share < upto)), w, pairs, soft, rate=0.02 / (k + 1))
            done = upto
    rest_log = float(v.band_logs()[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        Memo.enter("gru")

        def out() -> Iterator[pa.RecordBatch]:
            if w is None:
                neural = np.zeros(sum(b.num_rows for b in held))
            else:
                x, y, lengths = pairs.read([raw for b in held for raw in b.column(0).to_pylist()])
                ends = np.cumsum(lengths)[:-1]
                neural = document_logs(w, np.split(x, ends), np.split(y, ends), soft) / math.log(10)
                del x, y
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(neural[at : at + b.num_rows], pa.float64())], [*b.schema.names[1:], "neural"])
                at += b.num_rows

        for batch in sliced(batches, 0):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(0))).as_py() or 0
            if size >= unit_bytes:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    kept = looked_up.drop("ids", "rest", "times")
    scored = materialise(looked_up.select("ids", *kept.columns).mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("neural", T.DoubleType())])))
    rare = looked_up.select("row", F.inline(F.arrays_zip(F.col("rest").alias("word"), F.col("times").alias("times")))).join(counts, "word", "left")
    tail = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("tail_rest"), F.sum("times").alias("n_rest"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("known_rest"))
    both = scored.join(tail, "row", "left").na.fill(0, ["known_rest", "n_rest"]).na.fill(0.0, ["tail_rest"])
    nothing = F.lit(w is None)
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.col("known_rest")).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        F.when(nothing, F.lit(0.0)).otherwise(F.col("base_head") + F.col("tail_rest") - F.col("n_tokens") * F.lit(v.base_log)).alias("base_score"),
        F.when(nothing, F.lit(0.0)).otherwise(F.col("neural") + F.col("tail_head") + F.col("tail_rest") - F.col("n_rest") * F.lit(rest_log)).alias("score"),
    )
