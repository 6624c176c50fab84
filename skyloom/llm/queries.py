"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import op1_packing, op2_language, op4_toxicity, op5_url_rules, op6_substring, op7_spotsigs, op8_topk, op9_chosen_path, op10_mixing, op11_alignment, op12_whitening, op13_exact_dedup
from . import op3_token_counts as op3

_MODULES = {
    "op1_packing": op1_packing, "op2_language": op2_language, "op3_token_counts": op3, "op4_toxicity": op4_toxicity, "op5_url_rules": op5_url_rules,
    "op6_substring": op6_substring, "op7_spotsigs": op7_spotsigs, "op8_topk": op8_topk, "op9_chosen_path": op9_chosen_path, "op10_mixing": op10_mixing,
    "op11_alignment": op11_alignment, "op12_whitening": op12_whitening, "op13_exact_dedup": op13_exact_dedup,
}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _MODULES.items() if hasattr(m, "SQL")}
