"""The pipeline against a plain version, stage by stage."""

import pandas as pd
import public_tokenizers
import sentencepiece

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.toPandas())
        if name != "tokens":
            assert docs.columns == columns
    quality, exact, near, clean, tokens = kept
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    good = [i for i in labels.index if labels.quality[i] == 1 and labels.toxic[i] == 0]
    assert len(set(good) & set(quality.doc_id)) >= 0.95 * len(good)
    assert sorted(exact.doc_id) == sorted(quality.groupby("text").doc_id.min())
    # all pairs by their five-word shingles: groups at 0.85 are thinned to one, and what goes has a pair at 0.7
    sets = {i: shingles(t) for i, t in zip(exact.doc_id, exact.text, strict=True)}
    alike = {(a, b): len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1) for a in sets for b in sets if a < b}
    stays = set(near.doc_id)
    assert all(not (a in stays and b in stays) for (a, b), j in alike.items() if j >= 0.85)
    assert set(sets) - stays <= {x for pair, j in alike.items() if j >= 0.7 for x in pair}
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    leaks = {i for i, t in zip(near.doc_id, near.text, strict=True) if any(b in t for b in bench.text)}
    gone = set(near.doc_id) - set(clean.doc_id)
    assert leaks <= gone and len(gone - leaks) <= 2
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = dict(zip(tokens.doc_id, tokens.ids, strict=True))
    assert set(own) == set(clean.doc_id)
    for i, t in zip(clean.doc_id, clean.text, strict=True):
        assert list(own[i]) == model.encode(t)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
