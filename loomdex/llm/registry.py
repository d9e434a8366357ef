"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from loomdex.llm import chat_format, jaccard_join, media, mixing, piece_codec, pii, quality, secrets, token_codes, vector_topk
from loomdex.runtime import on_workers


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = {
        "op1_token_codes": token_codes.op1_token_codes,
        "op2_chat_format": chat_format.op2_chat_format,
        "op3_progressive_media": media.op3_progressive_media,
        "op4_quality": quality.op4_quality,
        "op5_pii_boosting": pii.op5_pii_boosting,
        "op6_temperature_mix": mixing.op6_temperature_mix,
        "op7_secret_ledger": secrets.op7_secret_ledger,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_piece_codec": piece_codec.op9_piece_codec,
        "op10_vector_topk": vector_topk.op10_vector_topk,
        "pipeline": pipeline,
    }
    return {name: (lambda spark, sf_dir, f=f: f(on_workers(spark), sf_dir)) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat_format.op2_sql(),
        "op8_jaccard_join": jaccard_join.op8_sql(),
        "op10_vector_topk": vector_topk.op10_sql(),
    }
