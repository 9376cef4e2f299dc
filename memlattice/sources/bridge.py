"""Rows of source tables as records, and records as export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a batch of export and of import, errors kept.
EXPORT_BATCH, ERRORS = 500, 1000


def row_text(table: str, columns: list[str], nested: tuple[str, ...] = ()) -> Column:
    """``[table]`` and a ``column: value`` line per non-null column; nested ones as JSON."""
    shown = [F.concat(F.lit(f"{c}: "), F.to_json(c) if c in nested else F.col(c).cast("string")) for c in columns]
    return F.concat_ws("\n", F.lit(f"[{table}]"), *shown)


def row_key(table: str, keys: list[str]) -> Column:
    return F.concat_ws(":", F.lit(table), *[F.col(c).cast("string") for c in keys])


def imported(rows: DataFrame, table: str, keys: list[str], parents: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with ``row_key``, ``row_text`` and ``parent_key`` (of the first foreign key; null where it is null)."""
    out = rows.withColumn("row_key", row_key(table, keys)).withColumn("row_text", row_text(table, rows.columns))
    parent = F.lit(None).cast("string")
    for column, (other, _) in list(parents.items())[:1]:
        parent = F.when(F.col(column).isNotNull(), F.concat_ws(":", F.lit(other), F.col(column).cast("string")))
    return out.withColumn("parent_key", parent)


def wrapped_binary(col: Column) -> Column:
    """Binary as the JSON object {"__binary": base64}; null stays null."""
    return F.when(col.isNotNull(), F.concat(F.lit('{"__binary":"'), F.regexp_replace(F.base64(col), "[\r\n]", ""), F.lit('"}')))


def unwrapped_binary(col: Column) -> Column:
    return F.unbase64(F.get_json_object(col, "$.__binary"))


def wrapped_date(col: Column) -> Column:
    return F.when(col.isNotNull(), F.concat(F.lit('{"__date":"'), F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"}')))


def unwrapped_date(col: Column) -> Column:
    return F.to_timestamp(F.get_json_object(col, "$.__date"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def export_rows(items: DataFrame, tags: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Items with any of ``tags``, lists joined by comma; ``limit`` takes the first by id."""
    out = items if tags is None else items.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    out = out.withColumn("tags", F.array_join("tags", ","))
    return out.orderBy("id").limit(limit) if limit else out
