"""SQL names for the functions that SQL users miss, as temporary SQL functions (no Python runs in them)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusgraph.functions.text import ACCENTED, PLAIN

FUNCTIONS = {
    "fold_accents(s STRING)": ("STRING", f"translate(lower(s), '{ACCENTED}', '{PLAIN}')"),
    "alias_key(s STRING)": ("STRING", f"regexp_replace(translate(lower(s), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]', '')"),
    "dot_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": (
        "DOUBLE",
        "coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), "
        "sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D)",
    ),
    "rrf_score(first_rank INT, second_rank INT, k INT, alpha DOUBLE)": (
        "DOUBLE", "coalesce(alpha / (k + first_rank), 0D) + coalesce((1 - alpha) / (k + second_rank), 0D)",
    ),
}


def register(spark: SparkSession) -> None:
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
