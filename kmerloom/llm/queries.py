"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audio, bpe, exact_dedup, jaccard, langid, mixing, mixlm, recompression, sharding, toxicity


def queries() -> dict:
    found = [
        audio.op1_audio_features,
        mixlm.op2_context_mixing,
        mixing.op3_pareto_mixing,
        exact_dedup.op4_exact_dedup,
        sharding.op5_stratified_shards,
        recompression.op6_substring_dedup,
        bpe.op7_bpe_codec,
        toxicity.op8_counterfactual_toxicity,
        jaccard.op9_signature_tree_join,
        langid.op10_language_masks,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_pareto_mixing": mixing.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op5_stratified_shards": sharding.ORACLE,
        "op6_substring_dedup": recompression.ORACLE, "op9_signature_tree_join": jaccard.ORACLE,
    }
