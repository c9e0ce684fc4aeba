"""All registered plans: ``QUERIES[key](spark, sf_dir) -> DataFrame`` and the
matching DuckDB SQL in ``ORACLE[key]`` (absent = rows-only check)."""

from __future__ import annotations

import importlib

_MODULES = ["corpus", "samples", "runs", "vectors", "weights", "lookups", "formats", "streams"]


def _load():
    queries, oracle = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"tokenloom.plans.{m}")
        queries.update(mod.QUERIES)
        oracle.update(getattr(mod, "ORACLE", {}))
    return queries, oracle


QUERIES, ORACLE = _load()
