"""Condition tables: column -> scalar or {operator: operand}, all joined by AND, compiled to one Catalyst predicate."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleframe.errors import RuleError
from ruleframe.functions.columns import NUMERIC, is_text, kind, q, require


def _literal(df: DataFrame, name: str, value: Any) -> Column:
    k = kind(df, name)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(k, NUMERIC) and not number:
        raise RuleError(f"column {name} holds numbers, the condition has {value!r}")
    if is_text(df, name) and not isinstance(value, str):
        raise RuleError(f"column {name} holds text, the condition has {value!r}")
    if isinstance(k, T.BooleanType) and not isinstance(value, bool):
        raise RuleError(f"column {name} holds truth values, the condition has {value!r}")
    if isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(str(value)).cast(k)
    return F.lit(value)


def _equals(df: DataFrame, name: str, value: Any) -> Column:
    if value is None:
        return q(name).isNull()
    if isinstance(value, list):  # a bare list asks for equality with the list, not for membership
        return q(name) == F.array(*map(F.lit, value)) if isinstance(kind(df, name), T.ArrayType) else F.lit(False)
    return q(name) == _literal(df, name, value)


def _text(operator: str, value: Any) -> str:
    if not isinstance(value, str):
        raise RuleError(f"{operator} takes a text, not {value!r}")
    return value


def _one(df: DataFrame, name: str, operator: str, value: Any) -> Column:
    c = q(name)
    if operator == "eq":
        return _equals(df, name, value)
    if operator == "ne":
        return c.isNotNull() if value is None else ~_equals(df, name, value)
    if operator in ("gt", "ge", "lt", "le"):
        x = _literal(df, name, value)
        return {"gt": c > x, "ge": c >= x, "lt": c < x, "le": c <= x}[operator]
    if operator in ("in", "not_in"):
        if not isinstance(value, list):
            raise RuleError(f"{operator} takes a list, not {value!r}")
        known = [_literal(df, name, v) for v in value if v is not None]
        inside = c.isin(*known) if known else F.when(c.isNotNull(), F.lit(False))
        return inside if operator == "in" else ~inside
    if operator in ("contains", "starts_with", "ends_with"):
        s, x = c.cast("string"), _text(operator, value)
        return {"contains": s.contains, "starts_with": s.startswith, "ends_with": s.endswith}[operator](x)
    if operator in ("is_null", "is_not_null"):
        if not isinstance(value, bool):
            raise RuleError(f"{operator} takes true or false, not {value!r}")
        return c.isNull() if value == (operator == "is_null") else c.isNotNull()
    raise RuleError(f"unknown operator {operator!r} for column {name}")


def predicate(df: DataFrame, conditions: dict[str, Any] | str) -> Column:
    """The predicate of a condition table, or of its JSON text. Rows on which it is null are not kept by a filter."""
    if isinstance(conditions, str):
        try:
            conditions = json.loads(conditions, strict=False)
        except ValueError as e:
            raise RuleError(f"the conditions are no JSON: {e}") from e
    if not isinstance(conditions, dict):
        raise RuleError("conditions must be an object of columns")
    require(df, conditions)
    parts = []
    for name, wanted in conditions.items():
        if isinstance(wanted, dict):
            if not wanted:
                raise RuleError(f"column {name} has an empty condition")
            parts += [_one(df, name, o, v) for o, v in wanted.items()]
        else:
            parts.append(_equals(df, name, wanted))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
