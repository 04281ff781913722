"""All registered query keys and their DuckDB twins."""

from __future__ import annotations

import importlib

MODULES = [
    "attrix.plans.q_attribution",
    "attrix.plans.q_overview",
    "attrix.plans.q_profile",
    "attrix.plans.q_ml_basic",
    "attrix.plans.q_models",
    "attrix.plans.q_forecast",
]


def _merge(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        mod = importlib.import_module(name)
        for k, v in getattr(mod, attr).items():
            if k in out:
                raise KeyError(f"duplicate query key {k}")
            out[k] = v
    return out


def queries() -> dict:
    return _merge("QUERIES")


def oracle_sql() -> dict:
    return _merge("ORACLE")
