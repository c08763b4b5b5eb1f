"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes that redaction markers and quasi-identifiers take.
MARKER = r"(?<![A-Za-z0-9])X{2,}(?![A-Za-z0-9])"
LOOSE_MARKER = r"(?<![A-Za-z0-9])X{2,}"
DATE_MARKER = r"XX/XX/(?:X{4}|[12][0-9]{3})"
BRACED_AMOUNT = r"\{\$[0-9][0-9,]*(?:\.[0-9]{2})?\}"
MARKER_RUN = r"(?<![A-Za-z0-9])X{2,}(?:[ \t]+X{2,})+(?![A-Za-z0-9])"
MERGED_MARKER = r"(?<![A-Za-z0-9])X{2,}(?:\s*/\s*(?:X{2,4}|[0-9]{2,4})|[ \t]+X{2,})*(?![A-Za-z0-9])"
DATE_SHAPE = r"^X{2}\s*/\s*X{2}\s*/\s*(?:X{2,4}|[0-9]{2,4})$|^X{2}\s*/\s*(?:X{2,4}|[0-9]{2,4})$"
AMOUNT = r"\$\s?([0-9][0-9,]*\.[0-9]{2})"
LONG_DATE = r"(?=[0-9])(?<![0-9A-Za-z_])([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9A-Za-z_])"
SHORT_DATE = r"(?=[0-9])(?<![0-9A-Za-z_])([0-9]{1,2}/[0-9]{1,2}/[0-9]{2})(?![0-9A-Za-z_])"
SLOT = r"\[\[([a-z0-9_]+)\]\]"
PLACEHOLDER = "[REDACTED]"


_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def ascii_edges(pattern: str) -> str:
    r"""The pattern with \b between ASCII word characters and others only, whatever the Java version takes for a word."""
    return pattern.replace(r"\b", _EDGE)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words(text: Column) -> Column:
    return find_all(text, r"\S+")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def longest_run(text: Column) -> Column:
    """Markers in the longest run of adjacent ones, 0 without a run."""
    return F.coalesce(F.array_max(F.transform(find_all(text, MARKER_RUN), lambda run: F.size(F.split(run, "[ \t]+")))), F.lit(0))


def mask_dates(text: Column, mask: str = "@DATE@") -> Column:
    return F.regexp_replace(text, DATE_MARKER, mask)


def left_words(text: Column, start: Column, n: int = 3) -> Column:
    """The last n words before a 0-based offset, lower-cased and without edge punctuation."""
    before = words(F.substring(text, F.lit(1), start))
    last = F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), F.lit(n))
    return F.transform(last, lambda w: F.regexp_replace(F.lower(w), r"^[^a-z0-9]+|[^a-z0-9]+$", ""))


def left_window(text: Column, start: Column, width: int) -> Column:
    return F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(F.lit(width), start))


def right_window(text: Column, end: Column, width: int) -> Column:
    return F.substring(text, end + 1, F.lit(width))


def company_key(name: Column) -> Column:
    """Lower-cased letters only, corporate endings dropped, spaces squeezed."""
    letters = F.regexp_replace(F.lower(name), "[^a-z]+", " ")
    bare = F.regexp_replace(letters, r"(^| )(inc|llc|ltd|corp|corporation|company|co|na|plc|lp|group|holdings)( |$)", " ")
    return F.trim(F.regexp_replace(bare, " +", " "))


def answer_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f]+", " "))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def amounts_in_cents(text: Column) -> Column:
    """Every $ amount with exactly two decimals, as integer cents."""
    return F.transform(find_all(text, AMOUNT, 1), lambda a: F.regexp_replace(a, "[,.]", "").try_cast("bigint"))


def dates(text: Column) -> Column:
    """m/d/yyyy dates, then m/d/yy ones in this century; impossible ones are skipped."""
    long = F.transform(find_all(text, LONG_DATE, 1), lambda d: F.try_to_date(d, "M/d/yyyy"))
    short = F.transform(find_all(text, SHORT_DATE, 1), lambda d: F.try_to_date(F.regexp_replace(d, "/([0-9]{2})$", "/20$1"), "M/d/yyyy"))
    return F.filter(F.concat(long, short), lambda d: d.isNotNull())


def as_markers(value: Column, most: int = 6) -> Column:
    """One marker for each word of a value."""
    return F.array_join(F.array_repeat(F.lit("XXXX"), F.least(word_count(value), F.lit(most))), " ")


def render(template: Column, fields: dict[str, Column]) -> Column:
    """A template with every [[slot]] that fields has filled in."""
    for name, value in fields.items():
        template = F.replace(template, F.lit(f"[[{name}]]"), value)
    return template


def slots(template: Column) -> Column:
    return find_all(template, SLOT, 1)


def us_date(day: Column, short: bool = False) -> Column:
    return F.date_format(day, "M/d/yy" if short else "M/d/yyyy")


def money(cents: Column) -> Column:
    """$1,234.00 from integer cents, by string assembly: no float is formatted."""
    whole = F.reverse(F.regexp_replace(F.reverse((cents / 100).cast("bigint").cast("string")), "([0-9]{3})(?=[0-9])", "$1,"))
    return F.concat(F.lit("$"), whole, F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))


def prompt(text: Column, question: str, options: list[str], most: int = 6000) -> Column:
    """Reader prompt: the start of the text, the options, and the form of the reply."""
    return F.concat_ws("\n", F.lit(question), F.concat(F.lit("Options: "), F.lit("; ".join(options + ["UNKNOWN"]))), F.lit('Reply as {"answer": "..."}.'), F.substring(text, 1, most))


def reply_answer(reply: Column) -> Column:
    """The answer of the outermost braces of a reply, null where that isn't JSON."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.from_json(body, "answer string", {"mode": "PERMISSIVE"})["answer"]


def draw(seed: str, key: Column, n: Column | int) -> Column:
    """An integer in 0..n-1 from a hash of seed and key, alike in every engine that has MD5."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, n if isinstance(n, Column) else F.lit(n))


def uniform(seed: str, key: Column) -> Column:
    """In [0, 1) from the same hash."""
    return draw(seed, key, 1 << 32) / F.lit(float(1 << 32))
