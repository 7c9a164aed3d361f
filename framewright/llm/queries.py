"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, exact_dedup, html_text, mixing, simhash, suffix_array, suffix_tree, token_counts, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_suffix_array_dedup": suffix_array.op2_suffix_array_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_suffix_tree_dedup": suffix_tree.op4_suffix_tree_dedup,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_decontamination": decontam.op7_decontamination,
        "op8_simhash": simhash.op8_simhash,
        "op9_html_text": html_text.op9_html_text,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": suffix_array.ORACLE, "op3_mixing": mixing.ORACLE, "op4_suffix_tree_dedup": suffix_tree.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE}
