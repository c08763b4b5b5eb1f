"""Synthetic populations and injection of labelled personal information.

Everything is drawn from hashes of ids, so populations nest: customer i, with all of
its transactions, is the same whatever the size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import rules
from umbra.functions import text as T
from umbra.functions.spans import SPANS
from umbra.operators import ranking

FIRST = ["Ada", "Bela", "Caro", "Dina", "Emil", "Fara", "Gino", "Hana", "Ivo", "Juna", "Kato", "Lio"]
LAST = ["Abbe", "Brook", "Cole", "Dunn", "Ester", "Flint", "Grove", "Hale", "Irwin", "Joss"]
CITIES = ["Northport", "Eastvale", "Southmere", "Westbrook", "Midland", "Lakeside"]
STEMS = ["Corner Grocery", "Quick Fuel", "Book Nook", "Garden Supply", "Night Diner"]
TXN_DAYS = 730


def pick(options: list[str], seed: str, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (T.draw(seed, key, len(options)) + 1).cast("int"))


def merchants(spark: SparkSession, n: int = 400) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(F.format_string("M%05d", i).alias("merchant_id"), F.concat(pick(STEMS, "stem", i), F.lit(" #"), i.cast("string")).alias("merchant_name"), pick(CITIES, "mcity", i).alias("city"), i.alias("ordinal"))


def customers(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    first, last = pick(FIRST, "first", i), pick(LAST, "last", i)
    return spark.range(n).select(
        F.format_string("C%08d", i).alias("customer_id"), i.alias("ordinal"), F.concat(first, F.lit(" "), last).alias("full_name"), pick(CITIES, "city", i).alias("city"),
        F.lpad(T.draw("zip", i, 100_000).cast("string"), 5, "0").alias("zip"), F.concat(F.lower(first), F.lit("."), i.cast("string"), F.lit("@example.com")).alias("email"),
    )


def cards(people: DataFrame) -> DataFrame:
    """One card each, two for 18 of 100."""
    count = F.when(T.draw("cards", F.col("ordinal"), 100) < 18, 2).otherwise(1)
    rows = people.select("customer_id", "ordinal", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    key = F.concat("customer_id", F.lit("/"), F.col("k").cast("string"))
    return rows.select(key.alias("card_id"), "customer_id", F.lpad(T.draw("last4", key, 10_000).cast("string"), 4, "0").alias("last4"))


def transactions(people: DataFrame, shops: DataFrame, n_shops: int) -> DataFrame:
    """12 to 60 each; log-normal cents between 1.50 and 4,800 dollars; days in a window of two years."""
    rows = people.select("customer_id", "ordinal", F.explode(F.sequence(F.lit(0), F.lit(11) + T.draw("txns", F.col("ordinal"), 49).cast("int"))).alias("k"))
    key = F.concat("customer_id", F.lit("/"), F.col("k").cast("string"))
    normal = F.sqrt(-2 * F.log(F.greatest(T.uniform("u", key), F.lit(1e-9)))) * F.cos(F.lit(2 * math.pi) * T.uniform("v", key))
    cents = F.floor(F.least(F.greatest(F.exp(F.lit(3.6) + F.lit(1.1) * normal), F.lit(1.5)), F.lit(4800.0)) * 100)
    made = rows.select(key.alias("txn_id"), "customer_id", cents.alias("cents"), F.date_add(F.lit("2023-01-01").cast("date"), T.draw("day", key, TXN_DAYS).cast("int")).alias("day"), T.draw("shop", key, n_shops).alias("shop"))
    shop = shops.select(F.col("ordinal").alias("shop"), "merchant_id", F.lower("merchant_name").alias("merchant"))
    return made.join(F.broadcast(shop) if n_shops <= 100_000 else shop, "shop").drop("shop")


def weighted_category(weights: dict[str, float], seed: str, key: Column) -> Column:
    """A category by cumulative weights of a hash uniform."""
    u = T.uniform(seed, key) * sum(weights.values())
    out, below = F.lit(list(weights)[-1]), sum(weights.values())
    for name in reversed(list(weights)[:-1]):
        below -= list(weights.values())[list(weights).index(name) + 1]
        out = F.when(u < below, name).otherwise(out)
    return out


def overlay(categories: Column, chances: dict[str, float], seed: str, key: Column) -> Column:
    """Drops the listed categories and adds each with a chance of its own."""
    rest = F.filter(categories, lambda c: ~c.isin(list(chances)))
    added = F.filter(F.array(*[F.when(T.uniform(f"{seed}-{c}", key) < p, c) for c, p in chances.items()]), lambda c: c.isNotNull())
    return F.concat(rest, added)


def splice(text: Column, items: Column) -> Column:
    """struct<text, spans, placed>: items put between sentences, one in each gap from the start on, with exact offsets.

    items is array<struct<lead string, value string, category string>>; lead text comes
    before the value, and a null category marks a hard negative that gets no span.
    Beyond one item more than there are sentences, items are left out.
    """
    parts = T.sentences(text)
    slots = F.arrays_zip(items.alias("item"), parts.alias("sentence"))

    def step(at: Column, slot: Column) -> Column:
        item, sentence = slot["item"], slot["sentence"]
        room = item.isNotNull() & (at["gap"] <= F.size(parts))
        lead = F.concat(at["text"], F.when(F.length(at["text"]) > 0, F.lit(" ")).otherwise(F.lit("")), item["lead"])
        body = F.when(room, F.concat(lead, item["value"], F.lit("."))).otherwise(at["text"])
        spans = F.when(room & item["category"].isNotNull(), F.array_append(at["spans"], F.struct(F.length(lead).alias("start"), (F.length(lead) + F.length(item["value"])).alias("end"), item["category"].alias("category")))).otherwise(at["spans"])
        joined = F.when(sentence.isNull(), body).otherwise(F.concat(body, F.when(F.length(body) > 0, F.lit(" ")).otherwise(F.lit("")), sentence))
        return F.struct(joined.alias("text"), spans.alias("spans"), (at["placed"] + room.cast("int")).alias("placed"), (at["gap"] + 1).alias("gap"))

    start = F.struct(F.lit("").alias("text"), F.array().cast(SPANS).alias("spans"), F.lit(0).alias("placed"), F.lit(0).alias("gap"))
    return F.aggregate(slots, start, step)


def carriers(parted: DataFrame, contexts) -> DataFrame:
    """doc_id, at, text, n, category, field, template and reason for sentences (doc_id, at, text).

    A sentence becomes a template where it has 6 to 45 words, one marker and a context
    that leaves no choice of category; reason is the first thing that is against it.
    """
    keys = ["doc_id", "at"]
    first = contexts(parted.select(*keys, "text"), *keys)
    n = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    one = first.join(n.where("n = 1").select(*keys), keys)
    category = F.nullif(rules.classify(rules.CERTAIN_RULES, F.col("lhs48"), F.col("mid"), F.lit(""))[0], F.lit("UNKNOWN"))
    named = one.select(*keys, "before", "behind", category.alias("category"), "lhs40")
    named = named.withColumn("field", rules.slot_field(F.col("category"), F.col("lhs40"), F.col("before")))
    named = named.withColumn("template", F.concat("before", F.lit("[["), "field", F.lit("]]"), "behind")).drop("lhs40")
    whole = parted.join(n, keys, "left").join(named, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = F.concat("before", "behind")
    reason = rules.reject_reason(
        [
            ("length", ~T.word_count(F.col("text")).between(6, 45)),
            ("markers", F.col("n") != 1),
            ("context", F.col("category").isNull()),
            ("leftover marker", F.col("template").rlike(T.LOOSE_MARKER)),
            ("formatting", F.contains(rest, F.lit("{$")) | F.contains(rest, F.lit("}"))),
        ]
    )
    return whole.withColumn("reason", reason).drop("before", "behind")


def split_carriers(mined: DataFrame, most: int | None = None) -> DataFrame:
    """(category, template, split): parted by source document; a template on both sides stays in training. most caps each list in its order."""
    dealt = ranking.hash_split(mined.where("reason is null").select("doc_id", "category", "template"), "doc_id", 0.7).select("category", "template", "split").distinct()
    train = dealt.where("split = 'train'")
    rest = dealt.where("split <> 'train'").join(train.select("category", "template"), ["category", "template"], "left_anti")
    both = train.unionByName(rest)
    return both if most is None else ranking.top_per(both, ["category", "split"], ["template"], most).drop("rank")
