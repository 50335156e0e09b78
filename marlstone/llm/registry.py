"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import exact_topk, licenses, mixing, packing, quality, secret_scan, simhash, substring_dedup, token_counts, vp_search

QUERIES = {
    "op1_topk": exact_topk.op1_topk,
    "op2_pack": packing.op2_pack,
    "op3_secrets": secret_scan.op3_secrets,
    "op4_simhash": simhash.op4_simhash,
    "op5_licenses": licenses.op5_licenses,
    "op6_substrings": substring_dedup.op6_substrings,
    "op7_quality": quality.op7_quality,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_mix": mixing.op9_mix,
    "op10_neighbours": vp_search.op10_neighbours,
}

SQL = {"op1_topk": exact_topk.SQL, "op6_substrings": substring_dedup.SQL, "op9_mix": mixing.SQL}
