"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from corpusgraph.llm import gam, joins, language, lines, manifest, media, middle, mixing, packing, passages, rules, suffixes, syncmers

QUERIES = {
    "op1_quality_rules": rules.op1_quality_rules,
    "op2_substring_dedup": passages.op2_substring_dedup,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_ngram_jaccard_join": joins.op4_ngram_jaccard_join,
    "op5_media_columns": media.op5_media_columns,
    "op6_quality_classifier": gam.op6_quality_classifier,
    "op7_mixing": mixing.op7_mixing,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_packing": packing.op9_packing,
    "op10_language_id": language.op10_language_id,
    "op11_fingerprints": syncmers.op11_fingerprints,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_fill_in_middle": middle.op13_fill_in_middle,
}

SQL = {
    "op7_mixing": mixing.OP7_SQL,
    "op8_line_dedup": lines.OP8_SQL,
    "op12_merkle_manifest": manifest.OP12_SQL,
    "op13_fill_in_middle": middle.OP13_SQL,
}
