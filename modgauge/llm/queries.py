"""The corpus operators as registered queries, with the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: name: (module, function, table, SQL or None)
REGISTERED = {
    "op1_language_id": ("language_id", "languages", "documents", None),
    "op2_simhash": ("simhash", "near_duplicates", "documents", None),
    "op3_quality_rules": ("quality_rules", "rules", "documents", None),
    "op4_token_binary": ("token_binary", "round_trip", "documents", None),
    "op5_pii": ("pii", "report", "documents", None),
    "op6_mixing": ("mixing", "mix_report", "documents", "ORACLE"),
    "op7_bpe": ("bpe", "digests", "documents", None),
    "op8_mil_quality": ("mil_quality", "quality", None, None),
    "op9_media": ("media", "round_trip", "documents", None),
    "op10_url_filter": ("url_filter", "judge", "pages", "ORACLE"),
}


def _query(module: str, function: str, table: str | None):
    def run(spark, sf_dir):
        operator = getattr(import_module(f"{__package__}.{module}"), function)
        return operator(spark, sf_dir) if table is None else operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    return run


def queries() -> dict:
    return {name: _query(module, function, table) for name, (module, function, table, _) in REGISTERED.items()}


def oracle_sql() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), sql) for name, (module, _, _, sql) in REGISTERED.items() if sql}
