"""All registered queries."""

from __future__ import annotations

import importlib

from .registry import ENTRIES, oracle_text, published

_MODULES = (
    "io_queries", "quality_queries", "clean_queries", "series_queries", "aggregate_queries",
    "relational_queries", "statistics_queries", "outlier_queries", "forecast_queries",
    "evaluation_queries", "policy_queries",
)


def _load():
    for module in _MODULES:
        importlib.import_module(f"{__package__}.{module}")


def _bound(entry):
    return lambda spark, sf_dir: published(entry.build(spark, sf_dir), entry)


def queries():
    _load()
    return {name: _bound(e) for name, e in ENTRIES.items()}


def oracle_sql():
    _load()
    return {name: oracle_text(e) for name, e in ENTRIES.items() if e.sql}
