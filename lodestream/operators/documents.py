"""Reads, updates and deletes over a collection of documents, each a lazy DataFrame.

Where the first of several documents counts, it is the one with the smallest id, by one partial minimum per task. Sorted
reads end in TakeOrderedAndProject, so only `offset + limit` rows of a task travel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import definite, matching, predicate


def get_document(df: DataFrame, key: Any, id_col: str = "_id") -> DataFrame:
    """The document with an id: one row or none."""
    return df.filter(F.col(id_col) == F.lit(key)).limit(1)


def find_document(df: DataFrame, query: Mapping[str, Any] | None, id_col: str = "_id") -> DataFrame:
    """The matching document with the smallest id."""
    return matching(df, query).orderBy(F.col(id_col).asc_nulls_last()).limit(1)


def query_documents(df: DataFrame, query: Mapping[str, Any] | None = None, limit: int = 0, offset: int = 0, sort_by: Sequence[tuple[str, int]] | None = None, id_col: str = "_id") -> DataFrame:
    """Matching documents: sorted, then `offset` skipped, then `limit` taken. Zero or less means no skip and no limit.

    sort_by: (field, 1 or -1) pairs; ties, and reads with a limit but no order, go by id. Nulls are smallest.
    """
    found = matching(df, query)
    bounded = limit > 0 or offset > 0
    order = [F.col(c).asc_nulls_first() if d >= 0 else F.col(c).desc_nulls_last() for c, d in sort_by or ()]
    if order or bounded:
        found = found.orderBy(*order, F.col(id_col).asc_nulls_first())
    if offset > 0:
        found = found.offset(offset)
    return found.limit(limit) if limit > 0 else found


def count_documents(df: DataFrame, query: Mapping[str, Any] | None = None) -> DataFrame:
    """One row: n, the number of matching documents."""
    return matching(df, query).agg(F.count(F.lit(1)).alias("n"))


def one_of_each(df: DataFrame, *keys: str) -> DataFrame:
    """One row of each key: that with the smallest hash of all its columns, so that it doesn't depend on partitions. A
    minimum, so that copies of one key are combined in the tasks that hold them."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    plain = [F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in df.schema.fields]
    by = [F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)]
    return df.groupBy(*by).agg(F.min_by(row, F.xxhash64(*plain)).alias("__row")).select("__row.*")


def new_documents(existing: DataFrame, incoming: DataFrame, id_col: str = "_id") -> DataFrame:
    """Incoming documents whose id is new: one for each id, by an anti-join on the ids alone."""
    return one_of_each(incoming.join(existing.select(id_col), id_col, "left_anti"), id_col)


def insert_documents(existing: DataFrame, incoming: DataFrame, id_col: str = "_id") -> DataFrame:
    """The collection after an insert that refuses ids already there. Missing columns are null."""
    return existing.unionByName(new_documents(existing, incoming, id_col), allowMissingColumns=True)


def _operators(updates: Mapping[str, Any]) -> dict[str, Mapping[str, Any]]:
    if not any(str(k).startswith("$") for k in updates):
        return {"$set": updates}
    unknown = [k for k in updates if k not in ("$set", "$unset", "$inc")]
    if unknown:
        raise ValueError(f"unknown update operator {unknown[0]}")
    return dict(updates)


def _changes(df: DataFrame, updates: Mapping[str, Any]) -> dict:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for name, value in (ops := _operators(updates)).get("$set", {}).items():
        out[name] = F.lit(value).cast(kinds[name]) if name in kinds else F.lit(value)
    for name, value in ops.get("$inc", {}).items():
        out[name] = (F.coalesce(F.col(f"`{name}`"), F.lit(0)) + F.lit(value)).cast(kinds[name]) if name in kinds else F.lit(value)
    for name in ops.get("$unset", {}):
        out[name] = F.lit(None).cast(kinds.get(name, "string"))
    return out


def update_where(df: DataFrame, condition, updates: Mapping[str, Any], changed: str | None = None) -> DataFrame:
    """df with updates ($set, $unset, $inc; a plain dict means $set) where a condition holds, in one pass.

    changed: name of a boolean column that tells which rows an update really altered.
    """
    values = _changes(df, updates)
    new = {}
    for name, value in values.items():
        old = F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")
        new[name] = F.when(condition, value).otherwise(old if name in df.columns else F.lit(None))
    if changed:
        differs = F.lit(False)
        for name, value in values.items():
            old = F.col(f"`{name}`") if name in df.columns else F.lit(None)
            differs = differs | ~value.eqNullSafe(old)
        df = df.withColumn(changed, condition & differs)
    return df.withColumns(new)


def update_document(df: DataFrame, key: Any, updates: Mapping[str, Any], id_col: str = "_id", changed: str | None = None) -> DataFrame:
    """The collection after an update of the document with an id."""
    return update_where(df, F.coalesce(F.col(id_col) == F.lit(key), F.lit(False)), updates, changed)


def update_documents(df: DataFrame, query: Mapping[str, Any] | None, updates: Mapping[str, Any], changed: str | None = None) -> DataFrame:
    """The collection after an update of all matching documents."""
    return update_where(df, definite(predicate(df.schema, query)), updates, changed)


def _first(df: DataFrame, query: Mapping[str, Any] | None, id_col: str) -> DataFrame:
    return matching(df, query).agg(F.min(id_col).alias("__first"))


def update_first(df: DataFrame, query: Mapping[str, Any] | None, updates: Mapping[str, Any], id_col: str = "_id", changed: str | None = None) -> DataFrame:
    """The collection after an update of the first matching document, whose id is a scalar subquery."""
    return update_where(df, F.coalesce(F.col(id_col) == _first(df, query, id_col).scalar(), F.lit(False)), updates, changed)


def delete_document(df: DataFrame, key: Any, id_col: str = "_id") -> DataFrame:
    """The collection without the document with an id."""
    return df.filter(~F.coalesce(F.col(id_col) == F.lit(key), F.lit(False)))


def delete_documents(df: DataFrame, query: Mapping[str, Any] | None) -> DataFrame:
    """The collection without all matching documents."""
    return df.filter(~definite(predicate(df.schema, query)))


def delete_first(df: DataFrame, query: Mapping[str, Any] | None, id_col: str = "_id") -> DataFrame:
    """The collection without the first matching document."""
    return df.filter(~F.coalesce(F.col(id_col) == _first(df, query, id_col).scalar(), F.lit(False)))
