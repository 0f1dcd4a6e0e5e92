"""Query registry: every public operator is exercised by at least one named query over the test tables.

``@query(name, ids=..., sql=...)`` registers a callable ``(spark, sf_dir) -> DataFrame`` together with the
DuckDB oracle text (omitted for seeded-property / non-SQL operators) and the SURVEY rows it covers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Entry:
    name: str
    fn: Callable
    ids: tuple[str, ...]
    sql: str | None
    doc: str = field(default="")


REGISTRY: dict[str, Entry] = {}


def query(name: str, ids: tuple[str, ...] | str = (), sql: str | None = None):
    if isinstance(ids, str):
        ids = (ids,)

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, tuple(ids), sql, (fn.__doc__ or "").strip())
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # importing the modules registers their queries
    import importlib
    import pkgutil

    import recsuite.plans as plans
    for m in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        if m.name.startswith("q_"):
            importlib.import_module(f"recsuite.plans.{m.name}")
    return REGISTRY
