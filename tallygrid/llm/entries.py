"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from tallygrid.llm import decontaminate, divergence, fingerprints, language_id, licenses, negatives, packing, quality, simhash, suffix_dedup, token_files, url_filters, windows

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_token_files": token_files.query,
    "op3_simhash": simhash.query,
    "op4_quality": quality.query,
    "op5_packing": packing.query,
    "op6_licenses": licenses.query,
    "op7_url_filters": url_filters.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_decontamination": decontaminate.query,
    "op10_fingerprints": fingerprints.query,
    "op11_negatives": negatives.query,
    "op12_windows": windows.query,
    "op13_divergence": divergence.query,
}
ORACLE_SQL = {"op7_url_filters": url_filters.ORACLE_SQL, "op9_decontamination": decontaminate.ORACLE_SQL, "op11_negatives": negatives.ORACLE_SQL, "op12_windows": windows.ORACLE_SQL, "op13_divergence": divergence.ORACLE_SQL}
