"""The queries of the training-data operators and, where it can express them, their SQL."""

from __future__ import annotations

from . import chat, decontamination, fingerprints, hard_negatives, merkle, near_dedup, packing, pieces, pii, quality, suffix_dedup, token_counts, token_files

QUERIES = {
    "op1_pieces": pieces.op1_pieces,
    "op2_token_files": token_files.op2_token_files,
    "op3_quality": quality.op3_quality,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_pii": pii.op8_pii,
    "op9_packing": packing.op9_packing,
    "op10_chat": chat.op10_chat,
    "op11_merkle": merkle.op11_merkle,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_decontaminate": decontamination.op13_decontaminate,
}
ORACLE: dict[str, str] = {
    "op3_quality": quality.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_decontaminate": decontamination.ORACLE_SQL,
}
