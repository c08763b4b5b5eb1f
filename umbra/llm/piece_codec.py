"""Exact encoding and decoding with a SentencePiece merge-type model, by backtracking over longest matches."""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from umbra.llm.common import Memo, id_and_text, sliced

SPACE = "▁"  # stands for a space inside pieces
OWNER = "piece_codec"
# bytes, roughly, that a worker process remembers: pairs of pieces, parts of words, and each of two generations of words
PAIR_BYTES, PART_BYTES, WORD_BYTES = 32_000_000, 40_000_000, 48_000_000
SHORT = 64  # characters up to which a part is remembered, and a word of known characters is one part


class PieceCodec:
    """Encodes as the library does for a merge-type model with the identity normaliser.

    A text is cut where no piece spans the cut: before a run of spaces, between
    characters that no chain of pieces ties together and, where that leaves long parts
    or characters that are no pieces, between two characters that never stand side by
    side in a piece. Each part is encoded alone and remembered. In a part, the longest match at a position is tried first, then its shorter prefixes;
    a token is taken if re-merging its text behind the token before gives back both
    (which of a match and its prefixes is the first to do so is remembered by the two
    ids); a position that leads nowhere is marked in a bit field and never tried again.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.plain = {p: i for i, p in enumerate(self.pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.score = {p: model.get_score(i) for p, i in self.plain.items()}
        self.value = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(len(self.pieces)) if model.is_control(i)}
        self.unknown = {i for i in range(len(self.pieces)) if model.is_unknown(i)}
        self.odd = self.silent | self.unknown | set(self.value)  # all but plain pieces
        self.prefixed = model.encode("\u0001", out_type=str)[0] == SPACE  # a space is put before the text
        long = [p for p in self.plain if len(p) > 1 and p.strip(SPACE)]
        if any(SPACE in p[1:] for p in long):
            raise ValueError("pieces with a space inside are not supported")
        self.pairs = {p[k : k + 2] for p in long for k in range(len(p) - 1)}
        self.cut = re.compile(_run_pattern(self.pairs)).findall
        self.runs = {len(p) for p in self.plain if not p.strip(SPACE)}
        self.fits = Memo(OWNER, PAIR_BYTES)
        self.sound = {p for p in self.plain if (p.strip(SPACE) or p == SPACE) and self.remerge(p) == [p]}  # merging makes these
        self.trie = ahocorasick.Automaton()
        for p in self.sound:
            if len(p) > 1:  # each character of a part is a piece anyway
                self.trie.add_word(p, self.plain[p])
        self.trie.make_automaton()
        self.sizes = [len(p) for p in self.pieces]
        self.shorter = [-1] * len(self.pieces)  # the next shorter piece that this one starts with
        for p in self.sound:
            self.shorter[self.plain[p]] = next((self.plain[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.sound), -1)
        self.names = [str(i).encode() for i in range(len(self.pieces))]
        self.said = [p.replace(SPACE, " ").encode() for p in self.pieces]
        self.parts = Memo(OWNER, PART_BYTES)
        self.words = _Words(self)

    def remerge(self, text: str) -> list[str]:
        """The merge rule itself: always the best-scored adjacent pair, the leftmost of equals."""
        got = list(text)
        while True:
            best, at = None, -1
            for k in range(len(got) - 1):
                s = self.score.get(got[k] + got[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return got
            got[at : at + 2] = [got[at] + got[at + 1]]

    def _fit(self, left: int, token: int) -> int:
        """The first of token and its shorter prefixes that re-merging keeps behind left, or -1."""
        key, before = left * len(self.pieces) + token, self.pieces[left]
        while token >= 0 and self.remerge(before + self.pieces[token]) != [before, self.pieces[token]]:
            token = self.shorter[token]
        return self.fits.put(key, token, 160)

    def backtrack(self, text: str) -> list[int]:
        """Ids of a part; KeyError if a character is no piece. One pass of the automaton gives the longest match at each position."""
        n, sizes = len(text), self.sizes
        longest = list(map(self.plain.__getitem__, text))
        for end, token in self.trie.iter(text):
            longest[end - sizes[token] + 1] = token  # matches come by their ends, so the last one from a position is its longest
        longest.append(-1)
        failed = bytearray(n + 1)
        known, wide = self.fits.get, len(self.pieces)
        got: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                if at:
                    found = known(got[-1] * wide + token)
                    if found is None:
                        found = self._fit(got[-1], token)
                    if found < 0:
                        token = -1
                        break
                    token = found
                end = at + sizes[token]
                if not failed[end]:
                    got.append(token)
                    at = end
                    token = longest[at]
                    break
                token = self.shorter[token]
            else:
                token = -1
            if token < 0 and at < n:
                failed[at] = 1
                if not at:
                    raise ValueError("no encoding")
                last = got.pop()
                at -= sizes[last]
                token = self.shorter[last]  # the taken one leads nowhere
        return got

    def _part(self, text: str) -> tuple[int, ...]:
        """Ids of a part; a character that is no piece becomes its UTF-8 bytes."""
        if len(text) == 1 and text not in self.plain:
            return tuple(self.bytes[b] for b in text.encode())
        return tuple(self.backtrack(text))

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of a text without spaces but for one leading mark."""
        if len(text) <= SHORT:
            try:
                return self._known(text)
            except KeyError:  # a character that is no piece
                pass
        cuts = [k for k, held in enumerate(map(self.pairs.__contains__, map(operator.add, text, text[1:])), 1) if not held]
        if not cuts:
            return self._known(text)
        out: list[int] = []
        start = 0
        for k in [*cuts, len(text)]:
            out += self._known(text[start:k])
            start = k
        return tuple(out)

    def _known(self, part: str) -> tuple[int, ...]:
        ids = self.parts.get(part)
        if ids is None:
            ids = self._part(part)
            if len(part) <= SHORT:
                self.parts.put(part, ids, 220 + 2 * len(part) + 8 * len(ids))
        return ids

    def spaces(self, n: int) -> list[int]:
        """Ids of n marks with no word behind: equal scores, so the leftmost pair always merges first."""
        got: list[int] = []
        for _ in range(n):
            got.append(1)
            while len(got) > 1 and got[-2] + got[-1] in self.runs:
                got[-2:] = [got[-2] + got[-1]]
        return [self.plain[SPACE * k] for k in got]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = (" " if self.prefixed else "") + text.replace(SPACE, " ")
        out: list[int] = []
        for m in re.finditer(r"( *)([^ ]*)", text):
            n, word = len(m[1]), m[2]
            if not word:
                out += self.spaces(n)
                continue
            ids = self.word(SPACE + word) if n else self.word(word)
            if n > 1 and ids[0] == self.plain[SPACE]:  # the mark stays alone, so it belongs to the run
                out += self.spaces(n) + list(ids[1:])
            else:
                out += self.spaces(n - 1) + list(ids) if n else list(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library's decode: runs of byte ids are read as UTF-8, bad bytes one by one as U+FFFD, and the space put before is taken away."""
        if self.odd.isdisjoint(ids):
            said = "".join(map(self.pieces.__getitem__, ids)).replace(SPACE, " ")
            return said[1:] if self.prefixed and said[:1] == " " else said
        out: list[str] = []
        held = bytearray()
        first = self.prefixed
        for i in ids:
            if i in self.value:
                held.append(self.value[i])
                first = False
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i in self.silent:
                continue
            piece = " ⁇ " if i in self.unknown else self.pieces[i].replace(SPACE, " ")
            if first and piece.startswith(" ") and i not in self.unknown:
                piece = piece[1:]
            first = False
            out.append(piece)
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out)

    def run(self, text: str) -> tuple[bytes, bytes]:
        """(ids joined by commas, what they decode to) of a run, the space before it included if there is one."""
        marked = text.replace(" ", SPACE)
        if len(text) <= SHORT:
            try:
                ids = self.backtrack(marked)
            except KeyError:  # a character that is no piece
                pass
            else:  # plain pieces only
                return b",".join(map(self.names.__getitem__, ids)), b"".join(map(self.said.__getitem__, ids))
        ids = self.word(marked)
        return b",".join(map(self.names.__getitem__, ids)), (" " * (text[0] == " ") + self.decode(ids)).encode()

    def coded(self, text: str) -> tuple[bytes, bytes]:
        """(ids joined by commas, the decoded text in UTF-8): by remembered runs where single spaces part the words."""
        if not self.prefixed or not text or "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            ids = self.encode(text)
            return ",".join(map(str, ids)).encode(), self.decode(ids).encode()
        got = list(map(self.words.__getitem__, self.cut(" " + text)))
        return b",".join([g[0] for g in got]), b"".join([g[1] for g in got])[1:]


def _run_pattern(pairs: set[str]) -> str:
    """Runs of characters that pieces tie together, directly or over others, with the space before; any other character is a run of its own. No piece spans two runs."""
    tied: dict[str, set[str]] = {}
    for a, b in pairs:
        if SPACE not in (a, b):
            one, other = tied.setdefault(a, {a}), tied.setdefault(b, {b})
            if one is not other:
                one |= other
                for c in other:
                    tied[c] = one
    groups = sorted({id(g): "".join(sorted(g)) for g in tied.values()}.values(), key=lambda g: (-len(g), g))
    sets = [re.sub(r"([\\\]\[^-])", r"\\\1", g) for g in groups]
    return "(?s: ?(?:" + "".join(f"[{g}]+|" for g in sets) + "." + "))"


class _Words(Memo):
    """Run, the space before it included -> (ids joined by commas, what the ids decode to), both as bytes."""

    def __init__(self, codec: PieceCodec):
        super().__init__(OWNER, WORD_BYTES)
        self.codec = codec
        self.old: dict[str, tuple[bytes, bytes]] = {}  # the generation before, so that frequent ones survive

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        made = self.old.get(word)
        if made is None:
            made = self.codec.run(word)
        if len(word) <= 48:
            size = 320 + 3 * len(word) + len(made[0])
            if self.size + size > self.most:
                held = dict(self)
                self.empty()
                self.old = held
            self.size += size
            self[word] = made
        return made

    def empty(self) -> None:
        super().empty()
        self.old = {}


def _utf8(raw: bytes) -> str:
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as bad:
            out.append(raw[: bad.start].decode())
            out.append("�")
            raw = raw[bad.start + 1 :]
    return "".join(out)


_loaded: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One for each worker process and model."""
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded for every row.

    path names the model file on each machine. Whole texts of any length; null counts
    as empty, and an empty text has no ids. Repeated rows are encoded alike. Columns
    other than doc_id and text are not read. No shuffle: a row's result depends on the
    row alone. An empty table gives an empty result.
    """
    slim = id_and_text(docs)
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        Memo.enter(OWNER)
        for batch in sliced(batches):
            counts, digests, saids, ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                csv, said = own.coded(text)
                counts.append(csv.count(b",") + 1 if csv else 0)
                digests.append(hashlib.sha256(csv).hexdigest())
                saids.append(hashlib.sha256(said).hexdigest())
                if with_ids:
                    ids.append(np.array(csv.split(b",") if csv else [], np.int32))
                    texts.append(said.decode())
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(saids, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return slim.mapInArrow(run, schema)
