"""Document filters: a nested dict becomes one Column predicate that Catalyst pushes down where it can.

A field that is null, or that a document lacks, compares as false, and `$ne`, `$nin`, `$nor` and `$not` are true for it. A
predicate may be null where it means false, which a filter takes alike and a scan can be asked for; negations make it false. `{field: None}` matches null and missing. Equality with a plain value also matches an array field
that holds the value. Unknown operators raise ValueError; nothing is taken for "match all" but an empty filter.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def _field(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """Column and type of a dotted path, or None where the schema lacks it."""
    kind: T.DataType = schema
    column: Column | None = None
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
        column = F.col(f"`{name}`") if column is None else column[name]
    return column, kind


def definite(predicate: Column) -> Column:
    """The predicate with false for null."""
    return F.coalesce(predicate, F.lit(False))


def _equals(column: Column, kind: T.DataType, value: Any) -> Column:
    if value is None:
        return column.isNull()
    if isinstance(kind, T.ArrayType):
        if isinstance(value, (list, tuple)):
            return column == F.array(*[F.lit(v) for v in value])
        return F.array_contains(column, F.lit(value))
    return column == F.lit(value)


def _condition(schema: T.StructType, path: str, operator: str, value: Any) -> Column:
    found = _field(schema, path)
    if operator == "$exists":
        present = F.lit(False) if found is None else found[0].isNotNull()
        return present if value else ~present
    if operator == "$not":
        return ~definite(_conditions(schema, path, value))
    if operator == "$ne":
        plain = found is not None and not isinstance(found[1], T.ArrayType) and value is not None
        return ~found[0].eqNullSafe(F.lit(value)) if plain else ~definite(_condition(schema, path, "$eq", value))
    if operator == "$nin":
        return ~definite(_condition(schema, path, "$in", value))
    if operator == "$in":
        options = list(value)
        plain = [v for v in options if v is not None]
        null = F.lit(False) if len(plain) == len(options) else _condition(schema, path, "$eq", None)
        if found is None or not plain:
            return null
        column, kind = found
        if isinstance(kind, T.ArrayType):
            return F.arrays_overlap(column, F.array(*[F.lit(v) for v in plain])) | null
        return column.isin(plain) | null if len(plain) < len(options) else column.isin(plain)
    if operator == "$eq":
        return F.lit(value is None) if found is None else _equals(*found, value)
    if operator in _COMPARE:
        return F.lit(False) if found is None else getattr(found[0], _COMPARE[operator])(F.lit(value))
    if operator == "$regex":
        return F.lit(False) if found is None else found[0].rlike(value)
    raise ValueError(f"unknown filter operator {operator}")


def _conditions(schema: T.StructType, path: str, value: Any) -> Column:
    if isinstance(value, Mapping) and any(str(k).startswith("$") for k in value):
        return _all([_condition(schema, path, op, v) for op, v in value.items()])
    return _condition(schema, path, "$eq", value)


def _all(parts: list[Column]) -> Column:
    out = F.lit(True) if not parts else parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _any(parts: list[Column]) -> Column:
    out = F.lit(False) if not parts else parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def predicate(schema: T.StructType, query: Mapping[str, Any] | None) -> Column:
    """The predicate of a filter over documents of a schema; null means false."""
    parts = []
    for key, value in (query or {}).items():
        if key == "$and":
            parts.append(_all([predicate(schema, q) for q in value]))
        elif key == "$or":
            parts.append(_any([predicate(schema, q) for q in value]))
        elif key == "$nor":
            parts.append(~definite(_any([predicate(schema, q) for q in value])))
        elif key.startswith("$"):
            raise ValueError(f"unknown filter operator {key}")
        else:
            parts.append(_conditions(schema, key, value))
    return _all(parts)


def matching(df: DataFrame, query: Mapping[str, Any] | None) -> DataFrame:
    """The documents that a filter matches."""
    return df.filter(predicate(df.schema, query)) if query else df
