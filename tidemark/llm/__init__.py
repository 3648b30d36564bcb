"""Operators for building training corpora.

Nothing outside this subpackage imports it.  Every module named ``opN_*``
holds one operator, its thin query ``opN_<name>(spark, sf_dir)`` and, where
SQL can say the same, its DuckDB text in ``SQL``.
"""

from importlib import import_module

MODULES = (
    "op1_ngram_jaccard",
    "op2_substring_dedup",
    "op3_language_id",
    "op4_source_mix",
    "op5_exact_topk",
    "op6_bpe",
    "op7_fingerprints",
    "op8_line_dedup",
    "op9_secret_scan",
    "op10_pii",
    "op11_url_filter",
    "op12_whitening",
    "op13_phrases",
)


def queries():
    """Name to ``(spark, sf_dir) -> DataFrame`` of the operators."""
    return {name: import_module(f"{__name__}.{name}").query for name in MODULES}


def oracle_sql():
    """Name to DuckDB SQL, for the operators that SQL can express."""
    found = {name: import_module(f"{__name__}.{name}").SQL for name in MODULES}
    return {name: sql for name, sql in found.items() if sql}
