"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, centroids, invertible, lines, merkle, mixture, privacy, repetition, shards, simhash, substrings, toxicity, warc

QUERIES = {
    "op1_ftrl_toxicity": toxicity.op1_ftrl_toxicity,
    "op2_invertible_sketch": invertible.op2_invertible_sketch,
    "op3_golden_schedule": mixture.op3_golden_schedule,
    "op4_weak_supervision": privacy.op4_weak_supervision,
    "op5_repetition_coverage": repetition.op5_repetition_coverage,
    "op6_simhash_pigeonhole": simhash.op6_simhash_pigeonhole,
    "op7_warc_round_trip": warc.op7_warc_round_trip,
    "op8_bpe_round_trip": bpe.op8_bpe_round_trip,
    "op9_feistel_shards": shards.op9_feistel_shards,
    "op10_minhash_lines": lines.op10_minhash_lines,
    "op11_hamerly_centroids": centroids.op11_hamerly_centroids,
    "op12_debruijn_passages": substrings.op12_debruijn_passages,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op7_warc_round_trip": warc.op7_sql,
    "op11_hamerly_centroids": centroids.op11_sql,
    "op12_debruijn_passages": substrings.op12_sql,
    "op13_merkle_manifest": merkle.op13_sql,
}
