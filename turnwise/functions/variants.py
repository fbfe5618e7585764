"""Typed access to fields of a VARIANT column.

``try_variant_get(v, path, 'string')`` would also return numbers and objects as
text.  A transcript field only counts when it has the expected JSON type, so the
getters check the type.  Containers are tested by a cast and not by
``schema_of_variant``, which would walk through everything inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame) -> DataFrame:
    """Keep the columns computed so far as they are.

    The optimiser copies a column's expression into every filter it pushes below
    it, such as the ``size(blocks) > 0`` it adds under an explode.  For parsed
    JSON that would parse each line once per copy.  A filter on a
    non-deterministic column cannot move, so everything below is computed once.
    The column ``_pin`` stays for the caller to drop.
    """
    return df.withColumn("_pin", F.spark_partition_id()).filter(F.col("_pin") >= 0)


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def members(v: Column, *names: str) -> Column:
    """struct of variants with the named members; null when ``v`` is not an object."""
    return F.try_variant_get(v, "$", "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")


def json_type(v: Column) -> Column:
    """Spark's schema text of the value: STRING, BIGINT, OBJECT<...>, VOID, ..."""
    return F.schema_of_variant(v)


def is_string(v: Column) -> Column:
    return F.coalesce(json_type(v) == "STRING", F.lit(False))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_null(v: Column) -> Column:
    """Absent, or JSON null."""
    return v.isNull() | F.is_variant_null(v)


def string(v: Column) -> Column:
    return F.when(json_type(v) == "STRING", F.try_variant_get(v, "$", "string"))


def integer(v: Column) -> Column:
    return F.when(json_type(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def boolean(v: Column) -> Column:
    return F.when(json_type(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def elements(v: Column) -> Column:
    """Array elements as array<variant>; null when the value is not an array."""
    return F.try_variant_get(v, "$", "array<variant>")


def entries(v: Column) -> Column:
    """Object members as map<string,variant>; null when the value is not an object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def truthy(v: Column) -> Column:
    """False for absent, null, false, 0, "" and empty containers."""
    return F.when(is_null(v), False).otherwise(
        ~F.to_json(v).isin("false", "0", "0.0", '""', "[]", "{}", "-0.0", "0E0")
    )


def first_truthy(a: Column, b: Column) -> Column:
    return F.when(truthy(a), a).otherwise(b)
