"""The queries of this package by name, and their DuckDB form where SQL can express them."""

from __future__ import annotations

from . import op1_weak_pii, op2_language, op3_forest, op4_templates, op5_suffixes, op6_randomness, op7_mixing, op8_positional, op9_minhash, op10_bitplanes, op11_codes, op12_windows, op13_divergence

QUERIES = {
    "op1_weak_pii": op1_weak_pii.query,
    "op2_language": op2_language.query,
    "op3_forest": op3_forest.query,
    "op4_templates": op4_templates.query,
    "op5_suffixes": op5_suffixes.query,
    "op6_randomness": op6_randomness.query,
    "op7_mixing": op7_mixing.query,
    "op8_positional": op8_positional.query,
    "op9_minhash": op9_minhash.query,
    "op10_bitplanes": op10_bitplanes.query,
    "op11_codes": op11_codes.query,
    "op12_windows": op12_windows.query,
    "op13_divergence": op13_divergence.query,
    "op4_whole_lines": op4_templates.query,
}
ORACLES: dict[str, str] = {
    "op4_templates": op4_templates.ORACLE,
    "op4_whole_lines": op4_templates.ORACLE,
    "op5_suffixes": op5_suffixes.ORACLE,
    "op6_randomness": op6_randomness.ORACLE,
    "op7_mixing": op7_mixing.ORACLE,
    "op8_positional": op8_positional.ORACLE,
    "op9_minhash": op9_minhash.ORACLE,
    "op11_codes": op11_codes.ORACLE,
    "op12_windows": op12_windows.ORACLE,
    "op13_divergence": op13_divergence.ORACLE,
}
