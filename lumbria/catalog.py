"""All queries of the core library by name, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that offer QUERIES: name -> (function, SQL or None).
MODULES: list[str] = ["lumbria.plans.usage", "lumbria.plans.places", "lumbria.plans.relational", "lumbria.plans.scalars", "lumbria.plans.trips", "lumbria.plans.more", "lumbria.plans.travel", "lumbria.plans.sources", "lumbria.plans.service", "lumbria.plans.rules", "lumbria.plans.fits", "lumbria.plans.networks", "lumbria.plans.prose", "lumbria.plans.versions", "lumbria.plans.nights", "lumbria.plans.timetables", "lumbria.plans.bands", "lumbria.plans.feasts"]


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out: dict = {}
    for m in MODULES:
        for name, pair in import_module(m).QUERIES.items():
            if name in out:
                raise ValueError(f"two queries are named {name}")
            out[name] = pair
    return out


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all()["A2_indicators"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
