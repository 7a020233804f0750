"""Queries of the corpus operators."""

from __future__ import annotations

from tessera.llm import leaks, packing, parsing, quality, rangecoder, ring, secrets, simhash, toxicity, viterbi


def queries():
    return {
        "op1_benchmark_decontamination": leaks.query,
        "op2_document_fingerprints": parsing.query,
        "op3_secret_scans": secrets.query,
        "op4_best_fit_packing": packing.query,
        "op5_token_counts": viterbi.query,
        "op6_quality_classifier": quality.query,
        "op7_toxicity": toxicity.query,
        "op8_sharding": ring.query,
        "op9_simhash_near_dedup": simhash.query,
        "op10_token_id_output": rangecoder.query,
    }


def oracle_sql():
    """Of the ten only decontamination is plain SQL; the others hash, train or encode as SQL can't."""
    return {"op1_benchmark_decontamination": leaks.SQL}
