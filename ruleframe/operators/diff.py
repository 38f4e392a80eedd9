"""Reconciliations as the step tables ask for them: by row, as a side-by-side report, by group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleframe.errors import RuleError
from ruleframe.functions.columns import kind, q, require, strip
from ruleframe.operators.table import rename_over
from ruleframe.operators.unify import union_relaxed


def _as_text(df: DataFrame, name: str) -> Column:
    nested = isinstance(kind(df, name), (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(q(name)) if nested else q(name).cast("string")


def diff_rows(first: DataFrame, second: DataFrame, check_columns: list[str] | None = None, exclude_columns: list[str] | None = None, column_map: dict[str, str] | None = None, source_column: str = "_tmp_diff_src") -> DataFrame:
    """Rows of either table whose compared columns occur exactly once in both together, tagged ``df_1`` or ``df_2``.

    Columns of the first are renamed by ``column_map`` before; all columns are compared as text, null like ''. A row
    repeated inside one table is therefore no difference, even if the other lacks it.
    """
    a = rename_over(first, column_map or {})
    names = [c for c in (check_columns or a.columns) if c not in (exclude_columns or [])]
    require(a, names, "first table")
    require(second, names, "second table")
    if source_column in a.columns or source_column in second.columns:
        raise RuleError(f"the column {source_column} is reserved")
    text = lambda df: df.select(*[F.coalesce(_as_text(df, c), F.lit("")).alias(c) for c in df.columns])
    both = union_relaxed([text(a).withColumn(source_column, F.lit("df_1")), text(second).withColumn(source_column, F.lit("df_2"))])
    # what is there once is its group's only row, so an aggregate keeps it, and repeats collapse before the exchange
    rest = [c for c in both.columns if c not in names]
    once = both.groupBy(*[q(c) for c in names]).agg(F.count("*").alias("__n"), F.min(F.struct(*[q(c) for c in rest])).alias("__rest")).where("__n = 1")
    return once.select(*[F.col("__rest").getField(c).alias(c) if c in rest else q(c) for c in both.columns])


def report(found: DataFrame, join_keys: list[str], source_column: str = "_tmp_diff_src") -> DataFrame:
    """``diff_rows`` side by side: keys, ``差异类型`` (增 added, 删 removed, 改 changed), ``旧_x`` and ``新_x`` of each other
    column, ``变更字段`` the changed ones. Of several rows with one key and side the smallest counts."""
    require(found, [*join_keys, source_column])
    values = [c for c in found.columns if c not in (*join_keys, source_column)]
    clean = lambda c: F.when(~F.lower(strip(q(c))).isin("nan", "none"), q(c)).alias(c)
    side = lambda s, mark: found.where(q(source_column) == s).groupBy(*[q(k) for k in join_keys]).agg(F.min(F.struct(*[clean(c) for c in values], F.lit(1).alias("__x"))).alias(mark)).select(*[q(k).alias(f"__{mark}{i}") for i, k in enumerate(join_keys)], mark)
    a, b = side("df_1", "l"), side("df_2", "r")
    met = a.join(b, reduce(lambda x, y: x & y, [F.col(f"__l{i}").eqNullSafe(F.col(f"__r{i}")) for i in range(len(join_keys))]), "full")
    l, r = F.col("l"), F.col("r")
    what = F.when(l.isNull(), "增").when(r.isNull(), "删").otherwise("改")
    changed = F.array_compact(F.array(*[F.when(~l.getField(c).eqNullSafe(r.getField(c)), F.lit(c)) for c in values])) if values else F.array().cast("array<string>")
    return met.select(
        *[F.when(l.isNotNull(), F.col(f"__l{i}")).otherwise(F.col(f"__r{i}")).alias(k) for i, k in enumerate(join_keys)],
        what.alias("差异类型"),
        *[x for c in values for x in (l.getField(c).alias(f"旧_{c}"), r.getField(c).alias(f"新_{c}"))],
        F.when(what == "改", changed).otherwise(F.array().cast("array<string>")).alias("变更字段"),
    )


def diff_groups(left: DataFrame, left_groupby: list[str], left_sum: list[str], right: DataFrame, right_groupby: list[str] | None = None, right_sum: list[str] | None = None, keep_groupby: str = "left", abs_delta: float = 0.5) -> DataFrame:
    """Sums by group on both sides, and groups in which any sum differs by ``abs_delta`` or more.

    Keys are compared as text, null as ``None``; a side that lacks the group counts 0. Text in a summed column that is
    no number stops the query. Columns: the keys (names of the kept side), ``<l>_left``, ``<r>_right``, ``<kept>_diff``.
    """
    right_groupby, right_sum = right_groupby or left_groupby, right_sum or left_sum
    if len(left_groupby) != len(right_groupby) or len(left_sum) != len(right_sum) or not left_groupby or not left_sum:
        raise RuleError("both sides need the same number of keys and of sums")
    if keep_groupby not in ("left", "right"):
        raise RuleError("keep_groupby is left or right")
    require(left, [*left_groupby, *left_sum], "left table")
    require(right, [*right_groupby, *right_sum], "right table")
    keep_keys, keep_sums = (left_groupby, left_sum) if keep_groupby == "left" else (right_groupby, right_sum)

    def side(df: DataFrame, keys: list[str], sums: list[str], mark: str) -> DataFrame:
        named = [F.coalesce(q(k).cast("string"), F.lit("None")).alias(n) for k, n in zip(keys, keep_keys)]
        return df.groupBy(*named).agg(*[F.coalesce(F.sum(q(s).cast("double")), F.lit(0.0)).alias(f"{s}_{mark}") for s in sums])

    met = side(left, left_groupby, left_sum, "left").join(side(right, right_groupby, right_sum, "right"), keep_keys, "full")
    for a, b, k in zip(left_sum, right_sum, keep_sums):
        met = met.withColumn(f"{k}_diff", F.coalesce(q(f"{a}_left"), F.lit(0.0)) - F.coalesce(q(f"{b}_right"), F.lit(0.0)))
    return met.where(reduce(lambda x, y: x | y, [F.abs(q(f"{k}_diff")) >= abs_delta for k in keep_sums]))
