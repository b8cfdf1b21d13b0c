"""The queries of this subpackage, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module that defines ``query(spark, sf_dir)``.
MODULES = {
    "op1_prefix_order_join": "op1_prefix_order_join",
    "op2_secret_scan": "op2_secret_scan",
    "op3_balanced_postings": "op3_balanced_postings",
    "op4_co_training": "op4_co_training",
    "op5_language_id": "op5_language_id",
    "op6_minimum_bin_slack": "op6_minimum_bin_slack",
    "op7_forced_boundary_bpe": "op7_forced_boundary_bpe",
    "op8_noisy_channel_toxicity": "op8_noisy_channel_toxicity",
    "op9_cross_polytope": "op9_cross_polytope",
    "op10_pii": "op10_pii",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
