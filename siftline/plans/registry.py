"""Named queries over the driver tables and their independent DuckDB SQL.

Each plan module exposes ``QUERIES`` (name -> callable) and ``ORACLE``
(name -> SQL text); the registry only merges them.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("siftline.plans.trust", "siftline.plans.reports", "siftline.plans.relational", "siftline.plans.texts", "siftline.plans.scored", "siftline.plans.boards", "siftline.plans.careers", "siftline.plans.searches", "siftline.plans.audits", "siftline.plans.pages", "siftline.plans.notices", "siftline.plans.contacts", "siftline.plans.profiles", "siftline.plans.rules")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(name), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query names registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict[str, Query]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
