"""Dependable data loading and reconciliation on Spark; the names most users need, imported when they are first used."""

from importlib import import_module

_HOMES = {
    "Pipeline": "pipeline",
    "load": "pipeline",
    "Policies": "plans.model",
    "TableSpec": "plans.model",
    "TableStore": "sources.store",
    "ConflictError": "sources.store",
    "jdbc_read": "sources.store",
    "jdbc_write": "sources.store",
    "read_any": "sources.readers",
    "run_jobs": "batch",
    "profile": "operators.profile",
    "infer_key": "operators.profile",
    "quantiles": "operators.quantiles",
    "diagnose": "capture",
}


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)


def __dir__() -> list[str]:
    return sorted([*globals(), *_HOMES])
