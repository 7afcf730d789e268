"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = [
    "suffix_dedup",
    "shingle_join",
    "line_dedup",
    "kd_shards",
    "token_counts",
    "packing",
    "quality_rules",
    "toxicity",
    "decontamination",
    "license_scan",
    "winnowing",
    "prefix_trie",
    "centroids",
]


def _modules():
    return [import_module(f"diamondframe.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "ORACLES", {}).items()}
