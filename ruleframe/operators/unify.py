"""Unions by name with a common type for columns of differing types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleframe.errors import RuleError
from ruleframe.functions.columns import NUMERIC, q
from ruleframe.functions.conditions import predicate

_WIDTH = {T.ByteType: 0, T.ShortType: 1, T.IntegerType: 2, T.LongType: 3, T.DecimalType: 4, T.FloatType: 5, T.DoubleType: 6}
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    """Void gives way; of numbers the wider holds; dates widen to timestamps; all else that differs becomes text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, NUMERIC) and isinstance(b, NUMERIC):
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            return T.DoubleType()
        wide = max(a, b, key=lambda t: _WIDTH[type(t)])
        return T.DoubleType() if isinstance(wide, T.FloatType) and not (isinstance(a, T.FloatType) and isinstance(b, T.FloatType)) else wide
    if isinstance(a, _TIMES) and isinstance(b, _TIMES):
        return T.TimestampType() if T.TimestampType() in (a, b) else T.TimestampNTZType()
    return T.StringType()


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; a column missing in one is null there."""
    if not frames:
        raise RuleError("a union needs at least one table")
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            kinds[f.name] = supertype(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    kinds = {n: T.StringType() if isinstance(k, T.NullType) else k for n, k in kinds.items()}

    def fit(df: DataFrame) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema}
        as_kind = lambda n, k: F.lit(None).cast(k) if n not in have else q(n) if have[n] == k else q(n).cast(k)
        return df.select(*[as_kind(n, k).alias(n) for n, k in kinds.items()])

    return reduce(DataFrame.unionByName, map(fit, frames))


def concat(frames: list[DataFrame], source_column: str | None = None, source_values: list | None = None) -> DataFrame:
    """Union of all frames; with ``source_column``, the i-th value of ``source_values`` tags the rows of the i-th frame."""
    if (source_column is None) != (source_values is None):
        raise RuleError("source column and values belong together")
    if source_column is not None:
        if len(source_values) != len(frames):
            raise RuleError("there must be one source value a table")
        frames = [df.withColumn(source_column, F.lit(v)) for df, v in zip(frames, source_values)]
    return union_relaxed(frames)


def replace_partition(database: DataFrame | None, upload: DataFrame, conditions: dict | str) -> DataFrame:
    """The database without the rows that satisfy the conditions, plus the upload.

    The upload must not be empty and all its rows must satisfy the conditions. Rows on which the predicate is null
    stay. A missing database counts as empty.
    """
    inside = predicate(upload, conditions)
    if conditions in ({}, "{}"):
        raise RuleError("the overwrite conditions are empty")
    n, outside = upload.agg(F.count("*"), F.count_if(~F.coalesce(inside, F.lit(False)))).first()
    if not n:
        raise RuleError("the upload is empty")
    if outside:
        raise RuleError(f"{outside} rows of the upload do not satisfy the overwrite conditions")
    if database is None:
        return upload
    return union_relaxed([database.where(~F.coalesce(predicate(database, conditions), F.lit(False))), upload])
