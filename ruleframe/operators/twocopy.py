"""Differences between two copies of a table, record by record and field by field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleframe.functions.columns import plain_text


def _side(rows: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    plain = [F.col(k) for k in keys]
    kept = rows.groupBy(*plain).agg(F.min(F.struct(*[F.col(f) for f in fields], F.lit(0).alias("__there"))).alias(name))
    return kept.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], name)


def _differs(kind: T.DataType, a: Column, b: Column, tolerance: float | None) -> Column:
    if isinstance(kind, T.StringType):
        return F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))
    same = a.eqNullSafe(b)
    if tolerance is not None:
        same = same | F.coalesce(F.abs(a - b) < F.lit(tolerance), F.lit(False))
    return ~same


def compare(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str] | None = None, tolerance: dict[str, float] | None = None, names: tuple[str, str] = ("df_1", "df_2")) -> DataFrame:
    """Records of one copy only, and the fields in which the others differ.

    A null-safe full outer join on ``keys``; the result has the keys, ``change`` (``only_`` and the copy's name, or
    ``changed``) and ``differences``, an array of (``field``, ``left_value``, ``right_value``), empty unless changed.
    ``fields`` defaults to the columns both copies have; ``layout`` tells what else they differ in. Values come as
    ``plain_text``.

    Defined results: null keys are equal to each other. Null text equals ''; other nulls equal only nulls. Numbers with
    a ``tolerance`` are equal if they lie less than it apart. Rows repeated inside a copy count once; if they differ,
    the smallest row counts (field by field, nulls first). Two empty copies give an empty result.
    """
    tolerance = tolerance or {}
    fields = [c for c in left.columns if c in right.columns and c not in keys] if fields is None else fields
    kinds = {f.name: f.dataType for f in left.schema}
    a, b = _side(left, keys, fields, "l"), _side(right, keys, fields, "r")
    met = a.join(b, reduce(lambda x, y: x & y, [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys]), "full")
    pairs = [(f, F.col("l").getField(f), F.col("r").getField(f)) for f in fields]
    each = [
        F.when(_differs(kinds[f], x, y, tolerance.get(f)), F.struct(F.lit(f).alias("field"), plain_text(kinds[f], x).alias("left_value"), plain_text(right.schema[f].dataType, y).alias("right_value")))
        for f, x, y in pairs
    ]
    none = F.array().cast("array<struct<field: string, left_value: string, right_value: string>>")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    found = met.select(
        *[F.when(F.col("l").isNotNull(), F.col(f"l_{k}")).otherwise(F.col(f"r_{k}")).alias(k) for k in keys],
        F.when(F.col("r").isNull(), f"only_{names[0]}").when(F.col("l").isNull(), f"only_{names[1]}").otherwise("changed").alias("change"),
        (F.when(both, F.array_compact(F.array(*each))).otherwise(none) if each else none).alias("differences"),
    )
    return found.where((F.col("change") != "changed") | (F.size("differences") > 0))


def layout(left: DataFrame, right: DataFrame) -> DataFrame:
    """(``field``, ``left_type``, ``right_type``): columns that only one copy has (null on the other side), or that have
    another type there. One row a column at most."""
    a, b = (dict(x.dtypes) for x in (left, right))
    rows = [(c, a.get(c), b.get(c)) for c in dict.fromkeys([*a, *b]) if a.get(c) != b.get(c)]
    return left.sparkSession.createDataFrame(rows, "field string, left_type string, right_type string")


def by_field(found: DataFrame, keys: list[str]) -> DataFrame:
    """``compare``'s result with one row for each differing field, and one with ``field_name`` '' for one-sided records."""
    alone = F.array(F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")))
    rows = found.withColumn("x", F.explode(F.when(F.col("change") == "changed", F.col("differences")).otherwise(alone)))
    return rows.select(*keys, "change", F.col("x.field").alias("field_name"), F.col("x.left_value").alias("left_value"), F.col("x.right_value").alias("right_value"))
