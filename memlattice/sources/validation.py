"""Checks of arguments and of rows against declared fields."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """What an argument must be: kind is ``string``, ``number``, ``integer``, ``boolean`` or ``json``."""

    name: str
    kind: str = "string"
    required: bool = False
    default: Any = None
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    choices: tuple = ()


def validated(args: dict, fields: list[Field]) -> tuple[dict, list[str]]:
    """(values with defaults, errors)."""
    import json

    out, errors = {}, []
    for f in fields:
        v = args.get(f.name)
        if v is None:
            if f.required:
                errors.append(f"{f.name} is required")
            elif f.default is not None:
                out[f.name] = f.default
            continue
        try:
            if f.kind in ("number", "integer"):
                v = float(v)
                if f.kind == "integer":
                    if v != int(v):
                        raise ValueError
                    v = int(v)
            elif f.kind == "boolean":
                v = {"true": True, "false": False, "1": True, "0": False}[str(v).lower()]
            elif f.kind == "json" and isinstance(v, str):
                v = json.loads(v)
        except (ValueError, KeyError):
            errors.append(f"{f.name} must be {f.kind}")
            continue
        if f.low is not None and v < f.low or f.high is not None and v > f.high:
            errors.append(f"{f.name} must be between {f.low} and {f.high}")
        elif f.pattern and not re.fullmatch(f.pattern, str(v)):
            errors.append(f"{f.name} has the wrong form")
        elif f.choices and v not in f.choices:
            errors.append(f"{f.name} must be one of {', '.join(map(str, f.choices))}")
        else:
            out[f.name] = v
    return out, errors


def row_errors(fields: list[Field]) -> Column:
    """ARRAY<STRING> of what is wrong with a row, for whole tables."""
    tests = []
    for f in fields:
        c = F.col(f.name)
        if f.required:
            tests.append(F.when(c.isNull(), f"{f.name} is required"))
        if f.kind in ("number", "integer"):
            n = c.cast("string").try_cast("double")
            tests.append(F.when(c.isNotNull() & n.isNull(), f"{f.name} must be {f.kind}"))
            if f.low is not None or f.high is not None:
                low, high = F.lit(f.low if f.low is not None else float("-inf")), F.lit(f.high if f.high is not None else float("inf"))
                tests.append(F.when(~n.between(low, high), f"{f.name} must be between {f.low} and {f.high}"))
        if f.pattern:
            tests.append(F.when(~c.rlike(f"^(?:{f.pattern})$"), f"{f.name} has the wrong form"))
        if f.choices:
            tests.append(F.when(~c.isin(*f.choices), f"{f.name} must be one of {', '.join(map(str, f.choices))}"))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def invalid_rows(df: DataFrame, fields: list[Field]) -> DataFrame:
    return df.withColumn("errors", row_errors(fields)).where(F.size("errors") > 0)
