"""Query registry: ``@query(name)`` on a function ``f(ctx) -> DataFrame``."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from lapse.plans.context import Ctx

QUERIES: dict[str, Callable[[Ctx], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn
    return deco


def as_entry(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from lapse.session import apply_conf, bound_tasks
        apply_conf(spark)          # UTC dates, AQE skew handling, ANSI
        bound_tasks(spark)
        return fn(Ctx(spark, sf_dir))
    run.__name__ = name
    return run
