"""Validated enrichment joins."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleframe.errors import RuleError
from ruleframe.functions.columns import is_text, q, require
from ruleframe.operators.unify import union_relaxed

POLICIES = ("raise", "keep_left", "keep_right", "keep_right_if_left_isnull")


def unique_or_raise(df: DataFrame, keys: list[str], what: str) -> None:
    again = df.groupBy(*[q(k) for k in keys]).count().where("count > 1").limit(3).collect()
    if again:
        raise RuleError(f"{what} repeats keys, such as {[tuple(r)[:-1] for r in again]}")


def merge_left(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, keep_right: list[str] | None = None, right_suffix: str = "", if_duplicate: str = "raise", check: bool = True) -> DataFrame:
    """Left join on a right side with unique keys; the number of rows stays.

    Right key columns are not kept. ``keep_right``: the right columns to add (default: all but the keys). Columns that
    both sides have get ``right_suffix``, and if they still clash ``if_duplicate`` decides: ``raise``, ``keep_left``,
    ``keep_right``, ``keep_right_if_left_isnull`` (null or ''). Null keys match nothing; two right rows with null keys
    count as repeated.
    """
    right_on = right_on or left_on
    if len(left_on) != len(right_on) or not left_on:
        raise RuleError("both sides need the same number of key columns")
    if if_duplicate not in POLICIES:
        raise RuleError(f"if_duplicate is one of {POLICIES}")
    require(left, left_on, "left table")
    require(right, [*right_on, *(keep_right or [])], "right table")
    if check:
        unique_or_raise(right, right_on, "the right table")
    added = [c for c in (keep_right or right.columns) if c not in right_on]
    names = {c: c + right_suffix if c in left.columns else c for c in added}
    clash = [n for n in names.values() if n in left.columns]
    if clash and if_duplicate == "raise":
        raise RuleError(f"both tables have the columns {sorted(clash)}")
    r = right.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(right_on)], *[q(c).alias(f"__r{i}") for i, c in enumerate(added)])
    met = left.join(r, reduce(lambda a, b: a & b, [q(k) == F.col(f"__k{i}") for i, k in enumerate(left_on)]), "left")
    from_right = {names[c]: F.col(f"__r{i}") for i, c in enumerate(added)}

    def pick(c: str):
        if c not in from_right or if_duplicate == "keep_left":
            return q(c)
        if if_duplicate == "keep_right":
            return from_right[c].alias(c)
        empty = q(c).isNull() | (q(c) == "") if is_text(left, c) else q(c).isNull()
        return F.when(empty, from_right[c]).otherwise(q(c)).alias(c)

    return met.select(*[pick(c) for c in left.columns], *[x.alias(n) for n, x in from_right.items() if n not in left.columns])


def enrich(left: DataFrame, metadata: DataFrame, relations: dict[str, Any] | str, dimension: str = "dimension", code: str = "element_code") -> DataFrame:
    """Attributes of dimension members: ``relations`` maps a column to ``{"dimension": d, "attributes": {source: output}}``.

    One join a relation, in order; existing columns are overwritten; output names may not repeat.
    """
    relations = json.loads(relations, strict=False) if isinstance(relations, str) else relations
    outputs = [o for r in relations.values() for o in r["attributes"].values()]
    if len(set(outputs)) < len(outputs):
        raise RuleError("an output column is named twice")
    known = {r[0] for r in metadata.select(dimension).distinct().collect()}
    for column, r in relations.items():
        if r["dimension"] not in known:
            raise RuleError(f"metadata has no dimension {r['dimension']!r}")
        part = metadata.where(F.col(dimension) == r["dimension"]).select(q(code).alias("__code"), *[q(s).alias(o) for s, o in r["attributes"].items()])
        left = merge_left(left, part, [column], ["__code"], if_duplicate="keep_right")
    return left


def assemble_by_pid(frames: list[DataFrame], pid: str = "pid") -> tuple[bool, DataFrame | None]:
    """Fragments of a wide table put together: rows by ``pid``, each column from the fragments that have it.

    Returns whether no (pid, column) occurs twice, and the table; no fragments give None, fragments with the pid only
    give the distinct pids of the first.
    """
    if not frames:
        return True, None
    columns = list(dict.fromkeys(c for df in frames for c in df.columns if c != pid))
    if not columns:
        return True, frames[0].select(q(pid)).distinct()
    stacked = [df.withColumns({f"__has_{k}": F.lit(c in df.columns) for k, c in enumerate(columns)}) for df in frames]
    whole = union_relaxed(stacked)
    wide = whole.groupBy(q(pid)).agg(
        *[F.max_by(q(c), F.when(F.col(f"__has_{k}"), F.lit(1))).alias(c) for k, c in enumerate(columns)],
        F.max(F.lit(0)).alias("__z"),
        *[F.count_if(F.col(f"__has_{k}")).alias(f"__n{k}") for k in range(len(columns))],
    )
    most = wide.agg(F.max(F.greatest(*[F.col(f"__n{k}") for k in range(len(columns))], F.lit(0)))).first()[0] or 0
    return most <= 1, wide.select(q(pid), *[q(c) for c in columns])
