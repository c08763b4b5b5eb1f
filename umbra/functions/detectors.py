"""Detectors: anything that turns texts into spans. Patterns stay in the JVM; models plug in through Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import spans as S
from umbra.functions.text import ascii_edges

# Structured personal information by its format.
STRUCTURED = {
    "GOV_ID": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "ACCOUNT_ID": r"\b(?:[0-9][ -]*?){13,16}\b",
    "CONTACT_EMAIL": r"\b[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.]+\b",
    "CONTACT_PHONE": r"\b(?:\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}\b",
    "CONTACT_URL": r"\bhttps?://\S+\b",
    "LOCATION_STREET": r"\b[0-9]{1,5}\s+[A-Z][a-z]+\s+(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Dr|Drive|Ln|Lane)\b",
    "LOCATION_ZIP": r"\b[0-9]{5}(?:-[0-9]{4})?\b",
}
WITH_MONEY = STRUCTURED | {"AMOUNT": r"\$\s?[0-9][0-9,]*\.[0-9]{2}\b"}

# texts -> for each a list of (start, end, label or None)
Detector = Callable[[list[str]], list[list[tuple[int, int, str | None]]]]


def by_patterns(text: Column, patterns: dict[str, str]) -> Column:
    """Merged spans of all patterns; an overlap keeps the category of what starts first."""
    found = [S.locate(text, ascii_edges(p), c.split("_")[0] if c.startswith(("CONTACT_", "LOCATION_")) else c) for c, p in patterns.items()]
    return S.merge(F.concat(*found))


def identity(text: Column) -> Column:
    """The raw arm: nothing is found."""
    return F.when(text.isNotNull(), S.no_spans()).otherwise(S.no_spans())


def by_model(docs: DataFrame, load: Callable[[], Detector], text: str = "text", batch: int = 64) -> DataFrame:
    """docs with the spans a model finds. load runs once in each worker task, so heavy models load there.

    Texts go in batches of like length; rows are told apart by position, so the order
    of the input comes back.
    """
    names = docs.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = load()
        for part in parts:
            texts = part[text].fillna("").tolist()
            found: list = [[] for _ in texts]
            order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                for k, got in zip(own, detect([texts[k] for k in own]), strict=True):
                    found[k] = [{"start": s, "end": e, "category": c} for s, e, c in got]
            yield part[names].assign(spans=pd.Series(found, index=part.index, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInPandas(run, f"{schema}, spans {S.SPANS}")


# Detectors that need packages or weights that may be missing: each says so when it is first used, not before.


def spacy_detector(model: str, labels: dict[str, str]) -> Callable[[], Detector]:
    def load() -> Detector:
        import spacy

        nlp = spacy.load(model)
        return lambda texts: [[(e.start_char, e.end_char, labels[e.label_]) for e in doc.ents if e.label_ in labels] for doc in nlp.pipe(texts)]

    return load


def presidio_detector(labels: dict[str, str], language: str = "en") -> Callable[[], Detector]:
    def load() -> Detector:
        from presidio_analyzer import AnalyzerEngine

        engine = AnalyzerEngine()
        return lambda texts: [[(r.start, r.end, labels.get(r.entity_type)) for r in engine.analyze(text=t, language=language)] for t in texts]

    return load


def token_classifier(path: str) -> Callable[[], Detector]:
    def load() -> Detector:
        from transformers import pipeline

        run = pipeline("token-classification", model=path, aggregation_strategy="simple")
        return lambda texts: [[(e["start"], e["end"], e["entity_group"]) for e in got] for got in run(texts)]

    return load


def tagging_writer(write: Callable[[list[str]], list[str]]) -> Callable[[], Detector]:
    """A model that rewrites texts with inline tags; its spans are recovered from what it wrote."""

    def load() -> Detector:
        from umbra.functions.tags import recover

        return lambda texts: [recover(t, w)[0] for t, w in zip(texts, write(texts), strict=True)]

    return load


def pattern_detector(patterns: dict[str, str]) -> Callable[[], Detector]:
    """The patterns as a model-shaped detector: the stand-in where no model can run."""

    def load() -> Detector:
        import re

        compiled = {c: re.compile(p, re.ASCII) for c, p in patterns.items()}
        return lambda texts: [sorted((m.start(), m.end(), c) for c, p in compiled.items() for m in p.finditer(t)) for t in texts]

    return load
