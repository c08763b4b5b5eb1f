"""Personal data: rule-based base spans, then boosted trees over overlapping candidate spans."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from umbra.llm.common import Memo, id_and_text, sliced

# fixed values: the kinds with rules, in the order in which ties at one start are listed
BASE_KINDS = ("email", "ip", "card", "phone")
# kinds that only the trees decide on, listed behind those
EXTRA_KINDS = ("secret", "ssn", "iban", "loose_phone", "hidden_email")

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches found from each @ outwards: linear in the text, however long a run of local characters is."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            floor = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return found


def base_spans(text: str) -> list[Span]:
    """All spans that the rules find, by start, then kind."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0]), s[2]))


# High-recall generators: (kind, pattern, group that is the span). They overlap freely.
GENERATORS = [
    ("secret", re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9+/_-]{16,}(?![A-Za-z0-9])"), 0),
    ("secret", re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key)["']?\s{0,3}[:=]\s{0,3}["']?([^\s"']{6,})"""), 1),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), 0),
    ("loose_phone", re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"), 0),
    ("hidden_email", re.compile(r"[A-Za-z0-9._-]{2,40} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{2,40}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z]{2,12}|\.[A-Za-z]{2,12})"), 0),
]
_SECRET_WORDS = re.compile(r"(?i)(token|secret|passw|pwd|key|auth|credential)")
_CALL_WORDS = re.compile(r"(?i)(phone|call|tel|mobile|fax|cell|dial|contact)")
_OTHER_WORDS = re.compile(r"(?i)(order|invoice|isbn|version|page|model|serial|part|ref|build|commit|sha|md5|checksum|uuid|id|no|date|total)\W{0,4}$")
_ID_WORDS = re.compile(r"(?i)(ssn|social|tax|security)")
FEATURES = 18


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, generator) of every proposal; generators run only where their anchor characters are."""
    found = []
    digits = bool(_DIGIT.search(text))
    for g, (kind, pattern, group) in enumerate(GENERATORS):
        if (kind == "hidden_email" and "(at)" not in text.lower() and "[at]" not in text.lower()) or (kind not in ("hidden_email", "secret") and not digits):
            continue
        if g == 1 and "=" not in text and ":" not in text:
            continue
        found += [(kind, m.start(group), m.end(group), g) for m in pattern.finditer(text)]
    return found


def describe(text: str, kind: str, start: int, end: int, generator: int) -> list[float]:
    """Format and context of a proposal."""
    body = text[start:end]
    n = len(body)
    digits = sum(c.isdigit() for c in body)
    letters = sum(c.isalpha() for c in body)
    counts = [body.count(c) for c in set(body)]
    spread = -sum(c / n * math.log2(c / n) for c in counts)
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    iban = 0.0
    if kind == "iban":
        flat = body.replace(" ", "")
        turned = "".join(str(int(c, 36)) for c in flat[4:] + flat[:4]) if flat.isalnum() and flat.isascii() else "0"
        iban = float(int(turned) % 97 == 1)
    return [
        float(EXTRA_KINDS.index(kind)),
        float(generator),
        float(n),
        digits / n,
        letters / n,
        sum(c.isupper() for c in body) / n,
        spread,
        float(sum(c in " .-()" for c in body)),
        float(all(c in "0123456789abcdef" for c in body)),
        float(bool(_SECRET_WORDS.search(before))),
        float(bool(_CALL_WORDS.search(before))),
        float(bool(_OTHER_WORDS.search(before))),
        float(bool(_ID_WORDS.search(before))),
        float(before[-1:] in "\"'" and before != "" and after[:1] in "\"'" and after != ""),
        float(re.search(r"[:=]\s*[\"']?$", before) is not None),
        iban,
        float(sum(body[k].isdigit() != body[k + 1].isdigit() for k in range(n - 1))),
        float(body.startswith("(") or body[:1] == "0"),
    ]


@dataclass
class Trees:
    """Boosted regression trees of depth 3 with a logistic loss; each is 7 splits and 8 leaves."""

    splits: list[list[tuple[int, float]]]
    leaves: list[list[float]]
    start: float
    rate: float = 0.3

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for splits, leaves in zip(self.splits, self.leaves, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(3):
                f = np.array([splits[k][0] for k in range(7)])[at]
                t = np.array([splits[k][1] for k in range(7)])[at]
                at = 2 * at + 1 + (x[np.arange(len(x)), f] > t)
            out += self.rate * np.array(leaves)[at - 7]
        return out


def _best_split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, float]:
    best = (1e-6, 0, np.inf)
    total_g, total_h = grad.sum(), hess.sum()
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        g, h = np.cumsum(grad[order])[:-1], np.cumsum(hess[order])[:-1]
        gain = np.where(v[1:] > v[:-1], g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1), 0)
        if len(gain) and gain.max() > best[0]:
            k = int(gain.argmax())
            best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    return best[1], best[2]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> Trees:
    base = float(np.clip(y.mean(), 0.01, 0.99))
    trees = Trees([], [], math.log(base / (1 - base)))
    score = np.full(len(x), trees.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(len(x), int)
        splits = [(0, math.inf)] * 7
        for level in range(3):
            for node in range((1 << level) - 1, (2 << level) - 1):
                here = at == node
                if here.sum() > 1:
                    splits[node] = _best_split(x[here], grad[here], hess[here])
            f = np.array([s[0] for s in splits])[at]
            t = np.array([s[1] for s in splits])[at]
            at = 2 * at + 1 + (x[np.arange(len(x)), f] > t)
        leaves = [float(grad[at == k].sum() / (hess[at == k].sum() + 1)) for k in range(7, 15)]
        trees.splits.append(splits)
        trees.leaves.append(leaves)
        score += trees.rate * np.array(leaves)[at - 7]
    return trees


def examples(n: int, seed: int) -> list[tuple[str, str, int, int, int, int]]:
    """Made-up snippets: (text, kind, start, end, generator, label) of every proposal the generators make in them."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioutnrshldmc") for _ in range(rnd.randint(2, 9)))
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(k))
    letters = lambda k: "".join(rnd.choice(string.ascii_letters) for _ in range(k))

    def iban(good: bool) -> str:
        land, rest = rnd.choice(["DE", "FR", "ES", "GB"]), digits(18)
        if not good:
            return land + digits(2) + rest
        check = 98 - int("".join(str(int(c, 36)) for c in rest + land + "00")) % 97
        return f"{land}{check:02d}{rest}"

    made = []
    while len(made) < n:
        quote = rnd.choice(['"', "'", ""])
        name = rnd.choice(["token", "secret", "password", "api_key", "auth token", "Token", "key"])
        phone = rnd.choice(["{}-{}-{}", "({}) {}-{}", "{} {} {}", "{}.{}.{}"]).format(digits(3), digits(3), digits(4))
        body, label = rnd.choice(
            [
                (f"{name}{rnd.choice([' = ', '=', ': '])}{quote}{rnd.choice([hexes, mixed])(rnd.randint(16, 64))}{quote}", 1),
                (f"{name}{rnd.choice([' = ', '=', ': '])}{quote}{rnd.choice([hexes, mixed, letters])(rnd.randint(20, 600))}{quote}", 1),
                (f"password: {mixed(rnd.randint(8, 14))}", 1),
                ("-".join(word() for _ in range(rnd.randint(3, 60))), 0),
                ("/".join(word() for _ in range(rnd.randint(3, 60))), 0),
                (f"{rnd.choice(['commit', 'sha', 'md5', 'checksum', 'build'])} {hexes(rnd.choice([32, 40, 64]))}", 0),
                ("-".join(word() for _ in range(rnd.randint(3, 6))) + "-2024", 0),
                ("/".join(word() for _ in range(rnd.randint(3, 6))) + digits(1), 0),
                (word() + word() + word() + word(), 0),
                (f"{rnd.choice(['token', 'key', 'secret'])}: {word()}{rnd.choice(['', ','])}", 0),
                (digits(rnd.randint(16, 24)), 0),
                (f"{rnd.choice(['SSN', 'social security', 'tax id', ''])} {digits(3)}-{digits(2)}-{digits(4)}", 1),
                (f"{rnd.choice(['part', 'order', 'serial'])} {digits(3)}-{digits(2)}-{digits(4)}", 0),
                (f"IBAN {iban(True)}", 1),
                (iban(True), 1),
                (iban(False), 0),
                (f"{rnd.choice(['call', 'phone', 'tel.', 'mobile', 'contact'])} {phone}", 1),
                (f"{rnd.choice(['order', 'isbn', 'invoice', 'version', 'page', 'total'])} {phone}", 0),
                (f"{digits(4)} {digits(4)} {digits(4)}", 0),
                (f"{word()}.{word()} {rnd.choice(['(at)', '[at]'])} {word()} {rnd.choice(['(dot)', '[dot]'])} com", 1),
                (f"{word()} (at) {word()}.{word()}", 1),
            ]
        )
        text = f"{word()} {word()} {word()} {body} {word()} {word()}{rnd.choice(['', '.'])}"
        made += [(text, kind, s, e, g, label) for kind, s, e, g in candidates(text)]
    return made[:n]


@dataclass
class Detector:
    """Trees, Platt calibration, and for each kind the chance from which a candidate is taken."""

    trees: Trees
    slope: float
    offset: float
    thresholds: dict[str, float]

    def chances(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.raw(x) + self.offset, -40, 40)))

    def extra(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates over their threshold that touch no base span; of overlapping ones the likeliest stays."""
        found = candidates(text)
        if not found:
            return []
        p = self.chances(np.array([describe(text, *c) for c in found]))
        taken: list[Span] = []
        blocked = [(s, e) for _, s, e in base]
        for k in sorted(range(len(found)), key=lambda k: (-p[k], found[k][1], found[k][2])):
            kind, s, e, _ = found[k]
            if p[k] >= self.thresholds[kind] and all(e <= a or b <= s for a, b in blocked):
                taken.append((kind, s, e))
                blocked.append((s, e))
        return taken


def train(n: int = 6_000, seed: int = 11, precision: float = 0.98) -> Detector:
    """Trained on made-up snippets; calibrated, and thresholds set, on others; the data never enter it."""
    learn, hold = examples(n, seed), examples(n // 2, seed + 1)
    x, y = np.array([describe(*e[:5]) for e in learn]), np.array([e[5] for e in learn], float)
    trees = boost(x, y)
    hx, hy = np.array([describe(*e[:5]) for e in hold]), np.array([e[5] for e in hold], float)
    raw = trees.raw(hx)
    w = np.array([1.0, 0.0])
    z = np.stack([raw, np.ones(len(raw))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        w -= np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.eye(2) * 1e-2, z.T @ (p - hy) + 1e-2 * (w - [1, 0]))
    made = Detector(trees, float(w[0]), float(w[1]), {})
    p = made.chances(hx)
    for kind in EXTRA_KINDS:
        own = np.array([e[1] == kind for e in hold])
        level = 0.5
        while level < 0.99 and hy[own & (p >= level)].mean() < precision:
            level += 0.02
        made.thresholds[kind] = level
    return made


def digest(text: str, detector: Detector) -> tuple:
    base = base_spans(text)
    order = {k: i for i, k in enumerate((*BASE_KINDS, *EXTRA_KINDS))}
    every = sorted(base + detector.extra(text, base), key=lambda s: (s[1], order[s[0]], s[2]))
    say = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return (*[sum(s[0] == k for s in base) for k in BASE_KINDS], hashlib.sha256(say(base).encode()).hexdigest(), say(every), len(every))


def find_personal_data(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans (base and added ones) for every row of docs.

    The rules' spans always stay; the trees add spans of EXTRA_KINDS where a
    generator's proposal passes its kind's calibrated threshold and touches no base
    span. Offsets are code points, ends exclusive. Null text counts as empty; repeated
    rows get equal results; other columns are not read; an empty table gives an empty
    result. No shuffle: each row stands alone, and the model is a few kilobytes.
    """
    model = detector or train()
    slim = id_and_text(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.enter("pii")
        for batch in sliced(batches):
            cols = zip(*[digest(t, model) for t in batch.column(1).to_pylist()], strict=True)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(text: str, spans: str, mark: str = "[{}]") -> str:
    """The text with each listed span replaced by its kind; of overlapping spans the first counts."""
    out, at = [], 0
    for item in filter(None, spans.split(",")):
        kind, start, end = item.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], mark.format(kind)]
            at = int(end)
    return "".join(out) + text[at:]
