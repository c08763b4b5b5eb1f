"""Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import types as T

from umbra.llm import anchors, exact_dedup, gru, hilbert, latent, pii, piece_codec, resampling, simhash, suffix_arrays

LONG = " ".join(f"word{k % 997} is" for k in range(30_000))
PASSAGE = " ".join(f"alpha{k} beta" for k in range(60))
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("key", "hits", "fp", "node", "component", "rank", "total", "size", "body", "h128", "hilbert", "word", "row", "kept", "class", "starts", "digest", "_kept_id")]
)
EXTRA = ["x"] * 18
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", None, 0),
    (3, " \t\n ", "en", "s", 4),
    (4, LONG, "en", "s", len(LONG)),
    (5, "a", "en", "s", 1),
    (6, "same words in this text", "en", "s", 23),
    (6, "same words in this text", "en", "s", 23),
    (7, "same words in this text", "fr", "t", 23),
    (8, PASSAGE + " tail one", "en", "s", 9),
    (9, "head two " + PASSAGE, "en", "s", 9),
    (10, "é😀 ▁ ẞ\x00 İ ﬁ  two  spaces  ", "xx", "s", 9),
]
LABELS = [(4, 1, 0), (5, 0, 1), (6, 1, None), (8, None, 0), (99, 1, 0)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([r + tuple(EXTRA) for r in ROWS], SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "one two"), (5, PASSAGE)], "item_id long, text string")
    return docs, labels, bench


MODEL = public_tokenizers.path("piece_bpe_32k.model")
OPERATORS = {
    "gru": lambda d, la, b: gru.score_documents(d),
    "hilbert": lambda d, la, b: hilbert.hilbert_shards(d),
    "codec": lambda d, la, b: piece_codec.encode_documents(d, MODEL),
    "suffix": lambda d, la, b: suffix_arrays.remove_repeated_bytes(d),
    "simhash": lambda d, la, b: simhash.simhash_groups(d),
    "anchors": lambda d, la, b: anchors.remove_repeats(d),
    "pii": lambda d, la, b: pii.find_personal_data(d),
    "exact": lambda d, la, b: exact_dedup.exact_groups(d),
    "resampling": lambda d, la, b: resampling.importance_resample(d, la),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_has_a_result(tables, name):
    got = OPERATORS[name](*tables).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(tables, name):
    docs, labels, bench = tables
    assert OPERATORS[name](docs.limit(0), labels.limit(0), bench).collect() == []


def test_decontamination_edges(tables):
    docs, _, bench = tables
    got = {(r["doc_id"], r["item_id"]) for r in latent.contaminated(docs, bench).collect()}
    assert got == {(8, 1), (8, 5), (9, 1), (9, 5)}
    assert latent.contaminated(docs.limit(0), bench).collect() == []
    assert latent.contaminated(docs, bench.limit(0)).collect() == []
    assert sorted(r["doc_id"] for r in latent.drop_contaminated(docs, bench).collect()) == [1, 2, 3, 4, 5, 6, 6, 7, 10]


def test_rows_kept_have_all_columns(tables):
    docs, labels, bench = tables
    for kept in (exact_dedup.drop_exact_copies(docs), simhash.drop_near_copies(docs), resampling.keep_resampled(docs, labels), latent.drop_contaminated(docs, bench)):
        assert kept.columns == docs.columns


def test_exact_groups_of_copies(tables):
    docs = tables[0]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs, keep="largest").collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (6, 7, 3, False), (7, 7, 3, True), (4, 4, 1, True)} <= got
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_copies(docs).collect()) == [1, 3, 4, 5, 6, 8, 9, 10]


def test_empty_texts_link(tables):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(tables[0]).collect()}
    assert got[1] == got[2] == got[3] == ("0" * 16, 1)
    assert got[6][1] == got[7][1] == 6


def test_passages_and_copies_go(tables):
    got = {r["doc_id"]: r for r in anchors.remove_repeats(tables[0]).collect()}
    assert got[8]["kept"] == "tail one" and got[9]["kept"] == "head two"
    assert got[1]["n_words"] == 0 and got[6]["n_removed"] == 0
    cut = {r["doc_id"]: r for r in suffix_arrays.remove_repeated_bytes(tables[0]).collect()}
    assert bytes(cut[8]["kept"]) == b" tail one" and bytes(cut[9]["kept"]) == b"head two "
    assert cut[4]["n_removed"] > 0 and cut[1]["n_bytes"] == 0
