"""All named queries and their oracle SQL, collected from the plan modules."""

from __future__ import annotations

import importlib

from lapse.plans.registry import QUERIES, as_entry

PLAN_MODULES = ("q_core", "q_eval", "q_prep", "q_models")
ORACLE_MODULES = ("oracle_core", "oracle_eval", "oracle_prep", "oracle_models")


def _load():
    for m in PLAN_MODULES:
        importlib.import_module(f"lapse.plans.{m}")


def queries():
    _load()
    return {name: as_entry(name) for name in QUERIES}


def oracle_sql():
    from lapse.plans.oracle_base import fix_rounding
    out = {}
    for m in ORACLE_MODULES:
        out.update(importlib.import_module(f"lapse.plans.{m}").ORACLE)
    _load()
    return {k: fix_rounding(v) for k, v in out.items() if k in QUERIES}
