"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, golay_simhash, language_id, lm_scoring, near_dedup, nearest, packing, quality, ranked_search, sentencepiece_codec, sessions, suffix_dedup, toxicity


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (
        near_dedup.op1_minhash_near_dedup, lm_scoring.op2_cross_entropy_difference, toxicity.op3_toxicity, sentencepiece_codec.op4_sentencepiece_codec, quality.op5_quality_gam,
        language_id.op6_language_id, suffix_dedup.op7_suffix_array_dedup, packing.op8_best_fit_packing, nearest.op9_additive_quantisation, exact_dedup.op10_exact_dedup, golay_simhash.op11_golay_simhash, ranked_search.op12_ranked_search, sessions.op13_gap_sessions,
    )
    return {f.__name__: f for f in own} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": exact_dedup.SQL, "op12_ranked_search": ranked_search.SQL, "op13_gap_sessions": sessions.SQL}
