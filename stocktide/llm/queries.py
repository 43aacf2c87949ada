"""Queries of the text operators: one for each numbered operator."""

from __future__ import annotations

from . import decontaminate, dom, encode, hard_negatives, imatch, language, metric_trees, packing, repeats, sentences, sequences, simhash, token_count


def queries() -> dict:
    return {
        "op1_bpe_encode": encode.op1_bpe_encode,
        "op2_language_mixture": language.op2_language_mixture,
        "op3_token_sequences": sequences.op3_token_sequences,
        "op4_suffix_repeats": repeats.op4_suffix_repeats,
        "op5_simhash_components": simhash.op5_simhash_components,
        "op6_imatch_fingerprints": imatch.op6_imatch_fingerprints,
        "op7_token_counts": token_count.op7_token_counts,
        "op8_benchmark_leaks": decontaminate.op8_benchmark_leaks,
        "op9_sentence_spans": sentences.op9_sentence_spans,
        "op10_main_text": dom.op10_main_text,
        "op11_pattern_packing": packing.op11_pattern_packing,
        "op12_vector_codes": metric_trees.op12_vector_codes,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_vector_codes": metric_trees.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
