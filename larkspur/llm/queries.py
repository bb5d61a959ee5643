"""The registered queries of the numbered operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from larkspur.llm import ann, covertree, lines, mixing, packing, quality, secrets, simhash, substrings, token_files
from larkspur.llm.oracles import ORACLES

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_token_files": token_files.op6_token_files,
    "op7_embedding_near_dedup": covertree.op7_embedding_near_dedup,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_nearest_neighbours": ann.op10_nearest_neighbours,
}

__all__ = ["ORACLES", "QUERIES"]
