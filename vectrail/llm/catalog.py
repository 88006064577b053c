"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from vectrail.llm import byte_bpe, decontaminate, exact_topk, language_id, license_scan, line_dedup, piece_counts, sharding, simhash, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_sharding": sharding.op2_sharding,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_piece_counts": piece_counts.op4_piece_counts,
    "op5_language_id": language_id.op5_language_id,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_exact_topk": exact_topk.op9_exact_topk,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLES: dict[str, str] = {
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op9_exact_topk": exact_topk.OP9_SQL,
}
