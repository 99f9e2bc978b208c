"""JSON files as documents. A file is a list of objects, an object with `items`, or an object whose values are documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_documents(spark: SparkSession, path: str, text_field: str = "content", id_field: str | None = None, underscore_guard: bool = True) -> DataFrame:
    """Documents of one or many JSON files: _id, text, title, type (strings) and body (the whole object as VARIANT).

    _id is the id_field where the document has it, else its own `_id`, else a digest of the document. With underscore_guard,
    a file that is an object with a key starting with `_` (and no `items`) has no documents; without, its values are taken.
    A JSON value of a file is parsed by one task; large collections belong into many files, or into read_json_lines.
    """
    files = spark.read.option("wholetext", "true").text(path)
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    items = F.array_contains(keys, "items")
    guarded = F.lit(underscore_guard) & ~items & F.exists(keys, lambda k: F.startswith(k, F.lit("_")))
    whole = F.parse_json("value")
    docs = files.filter(~guarded).select(F.when(items, F.variant_get(whole, "$.items", "variant")).otherwise(whole).alias("v"))
    each = docs.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("value").alias("body"))
    return _documents(each, text_field, id_field)


def read_json_lines(spark: SparkSession, path: str, text_field: str = "content", id_field: str | None = None) -> DataFrame:
    """The same from files with one document a line, which any number of tasks can share."""
    return _documents(spark.read.text(path).select(F.parse_json("value").alias("body")), text_field, id_field)


def _documents(bodies: DataFrame, text_field: str, id_field: str | None) -> DataFrame:
    get = lambda name: F.try_variant_get("body", f"$['{name}']", "string")
    key = [get(id_field)] if id_field else []
    return bodies.select(
        F.coalesce(*key, get("_id"), F.sha2(F.to_json("body"), 256)).alias("_id"), get(text_field).alias("text"),
        F.coalesce(get("title"), F.lit("")).alias("title"), F.coalesce(get("type"), F.lit("")).alias("type"), "body",
    )
