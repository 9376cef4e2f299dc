"""Vector clocks as MAP<STRING, BIGINT> expressions; an absent node counts as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Clock = Column | str


def _c(x: Clock) -> Column:
    return F.col(x) if isinstance(x, str) else x


def counter(clock: Clock, node: Column | str) -> Column:
    return F.coalesce(F.element_at(_c(clock), F.lit(node) if isinstance(node, str) else node), F.lit(0).cast("bigint"))


def tick(clock: Clock, node: Column | str, by: int = 1) -> Column:
    """``clock`` with ``node`` raised by ``by``."""
    n = F.lit(node) if isinstance(node, str) else node
    return F.map_zip_with(_c(clock), F.create_map(n, F.lit(by).cast("bigint")), lambda k, a, b: F.coalesce(a, F.lit(0).cast("bigint")) + F.coalesce(b, F.lit(0).cast("bigint")))


def merged(a: Clock, b: Clock) -> Column:
    """The larger count of each node."""
    return F.map_zip_with(_c(a), _c(b), lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0).cast("bigint")), F.coalesce(y, F.lit(0).cast("bigint"))))


def _any(a: Clock, b: Clock, less: bool) -> Column:
    z = F.lit(0).cast("bigint")
    side = lambda k, x, y: F.coalesce(x, z) < F.coalesce(y, z) if less else F.coalesce(x, z) > F.coalesce(y, z)
    return F.exists(F.map_values(F.map_zip_with(_c(a), _c(b), side)), lambda v: v)


def compared(a: Clock, b: Clock) -> Column:
    """``before``, ``after``, ``equal`` or ``concurrent``: where ``a`` stands to ``b``."""
    less, more = _any(a, b, True), _any(a, b, False)
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def dominates(a: Clock, b: Clock) -> Column:
    return compared(a, b) == "after"


def total(clock: Clock) -> Column:
    return F.aggregate(F.map_values(_c(clock)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def shown(clock: Clock) -> Column:
    """``node:count`` pairs by node, comma separated."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(_c(clock))), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
