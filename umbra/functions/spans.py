"""Span algebra: locate, merge, match, mask and score character ranges, all without UDFs.

A span is struct<start int, end int, category string>, half open, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.text import PLACEHOLDER, find_all

SPANS = "array<struct<start:int,end:int,category:string>>"


def span(start: Column, end: Column, category: Column | str) -> Column:
    named = F.lit(category) if isinstance(category, str) else category
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), named.cast("string").alias("category"))


def no_spans() -> Column:
    return F.array().cast(SPANS)


def locate(text: Column, pattern: str, category: str = "") -> Column:
    """All matches with their offsets: gaps and matches alternate, and lengths add up."""
    hits = find_all(text, pattern)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))

    def step(at: Column, pair: Column) -> Column:
        start = at["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        return F.struct(F.coalesce(end, at["at"]).alias("at"), F.when(pair["hit"].isNull(), at["found"]).otherwise(F.array_append(at["found"], span(start, end, category))).alias("found"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), no_spans().alias("found")), step, lambda at: at["found"])


def merge(spans: Column) -> Column:
    """Sorted disjoint spans; overlapping and touching ones become one with the first one's category."""

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(span(last["start"], F.greatest(last["end"], s["end"]), last["category"])))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), grown).otherwise(F.array_append(done, s))

    return F.aggregate(F.array_sort(spans), no_spans(), step)


def merge_rows(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same over rows (key, start, end, category): gaps and islands by window."""
    order = Window.partitionBy(key).orderBy("start", "end", "category")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    islands = flagged.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("start", "end", "category"))
    merged = islands.groupBy(key, "_island").agg(first.alias("_first"), F.max("end").alias("_end"))
    return merged.select(key, F.col("_first.start").alias("start"), F.col("_end").alias("end"), F.col("_first.category").alias("category"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def matches(truth: Column, guess: Column) -> Column:
    """They overlap, and the guess overruns the truth by half of its length at most."""
    over = F.greatest(truth["start"] - guess["start"], F.lit(0)) + F.greatest(guess["end"] - truth["end"], F.lit(0))
    return overlaps(truth, guess) & (over * 2 <= F.greatest(truth["end"] - truth["start"], F.lit(1)))


def any_matched(truths: Column, guesses: Column) -> Column:
    """Truths that some guess matches; a guess may serve several."""
    return F.filter(truths, lambda t: F.exists(guesses, lambda g: matches(t, g)))


def any_overlapped(truths: Column, guesses: Column) -> Column:
    return F.filter(truths, lambda t: F.exists(guesses, lambda g: overlaps(t, g)))


def greedy_pairs(truths: Column, guesses: Column) -> Column:
    """One-to-one matching: truths, in the order in which they are stored, each take the first free guess that matches.

    array<struct<truth, guess int>>, guess being the 0-based place among the guesses.
    """
    places = F.transform(guesses, lambda g, i: F.struct(g.alias("span"), i.alias("at")))
    kind = "array<struct<truth:struct<start:int,end:int,category:string>,guess:int>>"

    def step(taken: Column, t: Column) -> Column:
        free = F.filter(places, lambda p: matches(t, p["span"]) & ~F.exists(taken, lambda pair: pair["guess"] == p["at"]))
        first = F.try_element_at(free, F.lit(1))
        return F.when(F.size(free) > 0, F.array_append(taken, F.struct(t.alias("truth"), first["at"].alias("guess")))).otherwise(taken)

    return F.aggregate(truths, F.array().cast(kind), step)


def without_touching(guesses: Column, excluded: Column) -> Column:
    """Guesses that overlap no excluded range."""
    return F.filter(guesses, lambda g: ~F.exists(excluded, lambda x: overlaps(g, x)))


def covered(spans: Column) -> Column:
    """Characters under any of the spans."""
    return F.aggregate(merge(spans), F.lit(0), lambda n, s: n + s["end"] - s["start"])


def shared(a: Column, b: Column) -> Column:
    """Characters under both sides, from interval ends alone."""
    left, right = merge(a), merge(b)
    inner = lambda s: F.aggregate(right, F.lit(0), lambda n, t: n + F.greatest(F.least(s["end"], t["end"]) - F.greatest(s["start"], t["start"]), F.lit(0)))
    return F.aggregate(left, F.lit(0), lambda n, s: n + inner(s))


def replace_spans(text: Column, spans: Column, value: Column | str = PLACEHOLDER) -> Column:
    """The text with each of the merged spans replaced."""
    return replace_each(text, merge(spans), value)


def replace_each(text: Column, spans: Column, value: Column | str = PLACEHOLDER) -> Column:
    """The text with each span replaced; the spans are sorted and disjoint, and touching ones stay apart."""
    mark = F.lit(value) if isinstance(value, str) else value

    def step(at: Column, s: Column) -> Column:
        piece = F.concat(at["out"], F.substring(text, at["at"] + 1, s["start"] - at["at"]), mark)
        return F.struct(s["end"].alias("at"), piece.alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda at: F.concat(at["out"], F.substring(text, at["at"] + 1, F.length(text))))


def tag_spans(text: Column, spans: Column) -> Column:
    """Inline tags: <CATEGORY>value</CATEGORY> round each merged span."""

    def step(at: Column, s: Column) -> Column:
        value = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        before = F.substring(text, at["at"] + 1, s["start"] - at["at"])
        return F.struct(s["end"].alias("at"), F.concat(at["out"], before, F.lit("<"), s["category"], F.lit(">"), value, F.lit("</"), s["category"], F.lit(">")).alias("out"))

    return F.aggregate(merge(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda at: F.concat(at["out"], F.substring(text, at["at"] + 1, F.length(text))))


def fill_markers(text: Column, pattern: str, values: Column) -> Column:
    """struct<text, spans>: the k-th match becomes the k-th value (the last one when they run out), offsets follow the new text."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), find_all(text, pattern).alias("hit"))
    n = F.size(find_all(text, pattern))

    def step(at: Column, pair: Column) -> Column:
        fresh = F.concat(at["text"], pair["gap"])
        k = F.least(F.size(at["spans"]) + 1, F.size(values))
        value = F.try_element_at(values, k)
        put = F.struct(F.concat(fresh, value).alias("text"), F.array_append(at["spans"], span(F.length(fresh), F.length(fresh) + F.length(value), "FILLED")).alias("spans"))
        return F.when(F.size(at["spans"]) < n, put).otherwise(F.struct(fresh.alias("text"), at["spans"].alias("spans")))

    return F.aggregate(pairs, F.struct(F.lit("").alias("text"), no_spans().alias("spans")), step)


def safe_ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def f1(recall: Column, precision: Column) -> Column:
    return 2 * recall * precision / F.greatest(recall + precision, F.lit(1e-9))


def bio_spans(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans from rows (key, at, start, end, label) with labels O, B-X and I-X; zero-width tokens are skipped."""
    order = Window.partitionBy(key).orderBy("at")
    named = tokens.where("end > start").withColumn("_category", F.when(F.col("label") == "O", None).otherwise(F.substring("label", 3, 100)))
    before = F.lag("_category").over(order)
    new = (F.col("label").startswith("B-")) | before.isNull() | (before != F.col("_category"))
    runs = named.withColumn("_new", F.when(F.col("_category").isNotNull() & new, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = runs.where("_category is not null")
    return inside.groupBy(key, "_run", F.col("_category").alias("category")).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def bio_labels(tokens: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, at, label) for tokens (key, at, start, end): B where a token starts no later than its span, I behind, O outside."""
    s = spans.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("category").alias("_c"))
    hit = tokens.join(s, (tokens[key] == s[key]) & (tokens["start"] < s["_e"]) & (s["_s"] < tokens["end"]), "left").drop(s[key])
    label = F.when(F.col("_c").isNull(), "O").when(F.col("start") <= F.col("_s"), F.concat(F.lit("B-"), F.col("_c"))).otherwise(F.concat(F.lit("I-"), F.col("_c")))
    return hit.groupBy(key, "at").agg(F.min_by(label, "_s").alias("label")).select(key, "at", F.coalesce("label", F.lit("O")).alias("label"))
