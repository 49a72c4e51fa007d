"""Registered queries. Importing a module below fills the registry."""

from importlib import import_module

from riskloom.plans.registry import ORACLES, QUERIES

_MODULES = ("windows", "detect", "cases", "evaluate", "records", "learn", "streams", "flow")


def _load() -> None:
    for name in _MODULES:
        import_module(f"riskloom.plans.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
