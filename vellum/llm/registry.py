"""Queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import bpe, decontaminate, fill_in_middle, hard_negatives, imatch, lattice_lm, line_dedup, pii, quality_classifier, quality_rules, simhash, substring_dedup, url_filter

QUERIES = {
    "op1_neighbour_quality": quality_classifier.query,
    "op2_pii_anchors": pii.query,
    "op3_suffix_dedup": substring_dedup.query,
    "op4_url_filter": url_filter.query,
    "op5_simhash_trie": simhash.query,
    "op6_decontaminate": decontaminate.query,
    "op7_bpe": bpe.query,
    "op8_line_dedup": line_dedup.query,
    "op9_lattice_lm": lattice_lm.query,
    "op10_quality_rules": quality_rules.query,
    "op11_fill_in_middle": fill_in_middle.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_imatch": imatch.query,
}

#: DuckDB SQL.
ORACLE_SQL = {
    "op4_url_filter": url_filter.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_imatch": imatch.SQL,
}
