"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from umbra.llm import anchors, exact_dedup, gru, hilbert, latent, pii, piece_codec, resampling, simhash, suffix_arrays
from umbra.llm.common import read_documents


def op1_gru_scoring(spark, sf_dir):
    return gru.score_documents(read_documents(spark, sf_dir))


def op2_hilbert_sharding(spark, sf_dir):
    return hilbert.hilbert_shards(read_documents(spark, sf_dir), shards=24)


def op3_sentencepiece(spark, sf_dir):
    return piece_codec.encode_documents(read_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op4_suffix_arrays(spark, sf_dir):
    return suffix_arrays.remove_repeated_bytes(read_documents(spark, sf_dir), window=400, with_text=False)


def op5_simhash(spark, sf_dir):
    return simhash.simhash_groups(read_documents(spark, sf_dir), width=3, differ=3)


def op6_anchored_repeats(spark, sf_dir):
    return anchors.remove_repeats(read_documents(spark, sf_dir), window=35, with_text=False)


def op7_pii(spark, sf_dir):
    return pii.find_personal_data(read_documents(spark, sf_dir))


def op8_decontamination(spark, sf_dir):
    return latent.contaminated(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(read_documents(spark, sf_dir), keep="largest")


def op10_quality(spark, sf_dir):
    return resampling.importance_resample(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP9_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256
  FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_gru_scoring, op2_hilbert_sharding, op3_sentencepiece, op4_suffix_arrays, op5_simhash, op6_anchored_repeats, op7_pii, op8_decontamination, op9_exact_dedup, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": OP9_SQL}
