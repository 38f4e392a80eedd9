"""Filters, projections, reshaping and grouping of one table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleframe.errors import RuleError
from ruleframe.functions.columns import amounts, blank, is_text, kind, number, q, require
from ruleframe.functions.conditions import predicate
from ruleframe.operators.unify import supertype


def filter_rows(df: DataFrame, conditions: dict[str, Any] | str) -> DataFrame:
    return df.where(predicate(df, conditions))


def drop_empty(df: DataFrame, subset: list[str] | None = None, mode: str = "any") -> DataFrame:
    """Rows without (``any``) or not only with (``all``) empty cells: null, blank text, NaN. No subset: all columns."""
    if mode not in ("any", "all"):
        raise RuleError("mode is any or all")
    names = subset or df.columns
    require(df, names)

    def empty(n: str):
        if is_text(df, n):
            return blank(q(n))
        return q(n).isNull() | F.isnan(q(n)) if isinstance(kind(df, n), (T.FloatType, T.DoubleType)) else q(n).isNull()

    join = (lambda a, b: a | b) if mode == "any" else (lambda a, b: a & b)
    return df.where(~reduce(join, map(empty, names)))


def assign(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Constant columns, new or in place of old ones; null becomes a text column."""
    if not isinstance(values, dict) or not values or any(not isinstance(k, str) or not k.strip() for k in values):
        raise RuleError("values must map column names to constants")
    lit = lambda v: F.lit(None).cast("string") if v is None else F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return df.withColumns({k: lit(v) for k, v in values.items()})


def standardize(df: DataFrame, rules: list[dict[str, Any]], field_name: str) -> DataFrame:
    """Columns by rule: ``standard`` (new name), ``field_name`` (the column of ``rules`` with the old name), ``dtype``
    (``float``, ``string`` or null). Result order is rule order; a rule without a source gives a null column. Where one
    source feeds several standards the last one gets it."""
    named = [r for r in rules if r.get("standard") is not None]
    standards = [r["standard"] for r in named]
    if len(set(standards)) < len(standards):
        raise RuleError("a standard name occurs twice")
    require(df, [r[field_name] for r in named if r.get(field_name) is not None])
    feeds = {r[field_name]: r["standard"] for r in named if r.get(field_name) is not None}
    out = []
    for r in named:
        source, dtype = r.get(field_name), r.get("dtype")
        if dtype not in (None, "", "float", "string"):
            raise RuleError(f"dtype {dtype!r} of {r['standard']} is neither float nor string")
        if source is None or feeds[source] != r["standard"]:
            out.append(F.lit(None).cast("double" if dtype == "float" else "string").alias(r["standard"]))
            continue
        c = q(source)
        if dtype == "string":
            c = c.cast("string")
        elif dtype == "float":
            x = number(df, source)
            bad = ~blank(c) & x.isNull() if is_text(df, source) else c.isNotNull() & x.isNull()
            c = F.when(bad, F.raise_error(F.concat(F.lit(f"{source} is no number: "), c.cast("string"))).cast("double")).otherwise(x)
        out.append(c.alias(r["standard"]))
    return df.select(*out)


def rename_over(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename; a column that has the new name already goes. Names that are not there are passed over."""
    live = {a: b for a, b in names.items() if a in df.columns}
    gone = {b for a, b in live.items() if b != a and b not in live}
    return df.select(*[q(c).alias(live.get(c, c)) for c in df.columns if c not in gone])


def unpivot(df: DataFrame, columns: list[str], variable: str, value: str) -> DataFrame:
    """One row a listed column, nulls included; the values take their common type."""
    if not columns:
        raise RuleError("there are no columns to unpivot")
    require(df, columns)
    ids = [c for c in df.columns if c not in columns]
    if {variable, value} & set(ids) or variable == value:
        raise RuleError("the new columns clash with others")
    common = reduce(supertype, [kind(df, c) for c in columns])
    fit = df.select(*[q(c) for c in ids], *[q(c).cast(common).alias(c) for c in columns])
    return fit.unpivot([q(c) for c in ids], [q(c) for c in columns], variable, value)


def pivot_first(df: DataFrame, ids: list[str], variable: str, value: str, names: list) -> DataFrame:
    """Long to wide: the first value of each of ``names`` by ``ids``."""
    return df.groupBy(*[q(c) for c in ids]).pivot(variable, names).agg(F.first(q(value), ignorenulls=True))


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold nulls only; one pass."""
    counts = df.agg(*[F.count(q(c)).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[q(c) for c in df.columns if counts[c]])


def group_keys(df: DataFrame, sum_by: list[str], group_by: list[str] | None, exclude: list[str] | None) -> list[str]:
    if group_by and exclude:
        raise RuleError("either the keys or the excluded columns can be given")
    require(df, [*sum_by, *(group_by or []), *(exclude or [])])
    rest = [c for c in df.columns if c not in sum_by]
    if group_by:
        return [c for c in group_by if c not in sum_by]
    return [c for c in rest if c not in (exclude or [])] or rest


def group_sum(df: DataFrame, sum_by: list[str] | None = None, group_by: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Sums by the keys (all other columns, unless given or excluded); without sums the distinct keys. Null is a key."""
    sum_by = sum_by or []
    keys = group_keys(df, sum_by, group_by, exclude)
    fit = amounts(df, sum_by)
    if not sum_by:
        return fit.select(*[q(k) for k in keys]).distinct()
    return fit.groupBy(*[q(k) for k in keys]).agg(*[F.coalesce(F.sum(q(s)), F.lit(0.0)).alias(s) for s in sum_by])


def group_sum_checked(df: DataFrame, sum_by: list[str], group_by: list[str] | None = None, exclude: list[str] | None = None, abs_delta: float = 0.2) -> tuple[DataFrame, Callable[[], None]]:
    """``group_sum``, and a check to call when the result has been written: totals before and after may differ by ``abs_delta``."""
    before, after = Observation(), Observation()
    total = reduce(lambda a, b: a + b, [F.coalesce(F.sum(q(s)), F.lit(0.0)) for s in sum_by]).alias("total")
    keys = group_keys(df, sum_by, group_by, exclude)
    seen = amounts(df, sum_by).observe(before, total)
    result = seen.groupBy(*[q(k) for k in keys]).agg(*[F.coalesce(F.sum(q(s)), F.lit(0.0)).alias(s) for s in sum_by]).observe(after, total)

    def verify() -> None:
        a, b = before.get["total"] or 0.0, after.get["total"] or 0.0
        if abs(a - b) > abs_delta:
            raise RuleError(f"the sums differ: {a} before grouping, {b} after")

    return result, verify
