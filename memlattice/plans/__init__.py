"""Named queries over the driver's tables, with their SQL."""

from importlib import import_module

_MODULES = ("data_problems", "vectors", "texts", "graphs", "logs", "records", "streams", "cycles", "memory")


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in _MODULES:
        module = import_module(f"memlattice.plans.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
