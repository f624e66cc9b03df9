"""Queries of this folder's operators, and DuckDB SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("p1_language", "p2_pii", "p3_encoding", "p4_names", "p5_glyphs", "p6_packing", "p7_leakage", "p8_reading")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Functions named pN_... of the operators' modules."""
    out = {}
    for name in _MODULES:
        module = import_module(f"{__package__}.{name}")
        out |= {k: v for k, v in vars(module).items() if k.startswith(name.split("_")[0] + "_") and callable(v) and v.__module__ == module.__name__}
    return out


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can state: what results have to keep, and cases that are evident from characters."""
    out: dict[str, str] = {}
    for name in _MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), "SQL", {})
    return out
