"""The registered queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name, module. Every module has query(spark, sf_dir) and, where SQL can express it, SQL.
MODULES = {
    "op1_fingerprints": "op01_fingerprints",
    "op2_bpe": "op02_bpe",
    "op3_suffix_dedup": "op03_suffix_dedup",
    "op4_pii": "op04_pii",
    "op5_ngram_join": "op05_ngram_join",
    "op6_mixing": "op06_mixing",
    "op7_media": "op07_media",
    "op8_line_dedup": "op08_line_dedup",
    "op9_language_id": "op09_language_id",
    "op10_warc": "op10_warc",
    "op11_vector_codes": "op11_vector_codes",
    "op12_lexical_search": "op12_lexical_search",
    "op13_byte_bpe": "op13_byte_bpe",
}


def queries() -> dict:
    return {name: import_module(f"accolade.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"accolade.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
