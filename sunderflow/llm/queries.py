"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, fill_in_middle, language_id, line_dedup, mixing, quality, sharding, simhash, suffix_dedup, token_counts, token_files, vector_codes

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_sharding": sharding.op4_sharding,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_quality": quality.op6_quality,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_mixing": mixing.op8_mixing,
    "op9_simhash": simhash.op9_simhash,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_token_files": token_files.op12_token_files,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

SQL = {
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op4_sharding": sharding.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_decontamination": decontaminate.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
