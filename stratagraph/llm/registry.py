"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_sum_of_squares_packing": "packing",
    "op2_ngram_quality_rules": "quality_rules",
    "op3_token_id_index": "binary_index",
    "op4_fourier_kernel_quality": "kernel_quality",
    "op5_weighted_near_duplicates": "neardup",
    "op6_edit_aware_counts": "edit_counts",
    "op7_benchmark_matches": "decontamination",
    "op8_prefix_sum_sharding": "sharding",
    "op9_induced_toxicity": "toxicity",
    "op10_licence_paragraphs": "license_scan",
}


def _module(name: str):
    return importlib.import_module(f"stratagraph.llm.{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(_module(name), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name in MODULES if hasattr(m := _module(name), "ORACLE")}
