"""The queries of the subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import language_id, line_dedup, merkle, mixing, packing, piecewise, pii, quality, simhash, token_files, topk, url_filters, variants


def queries():
    return {
        "op1_url_filters": url_filters.op1_url_filters,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_language_id": language_id.op3_language_id,
        "op4_token_files": token_files.op4_token_files,
        "op5_mixing": mixing.op5_mixing,
        "op6_topk": topk.op6_topk,
        "op7_simhash": simhash.op7_simhash,
        "op8_packing": packing.op8_packing,
        "op9_pii": pii.op9_pii,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_spelling_variants": variants.op11_spelling_variants,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_fingerprints": piecewise.op13_fingerprints,
    }


def oracle_sql():
    return {
        "op1_url_filters": url_filters.OP1_SQL,
        "op2_line_dedup": line_dedup.OP2_SQL,
        "op5_mixing": mixing.OP5_SQL,
        "op6_topk": topk.OP6_SQL,
        "op11_spelling_variants": variants.OP11_SQL,
        "op12_merkle_manifest": merkle.OP12_SQL,
    }
