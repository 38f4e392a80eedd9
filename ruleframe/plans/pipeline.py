"""Schedules of steps: validated as a whole, previewed, then run in order."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ruleframe.errors import RuleError
from ruleframe.plans.steps import STEPS, Store, bind, call, resolve

COLUMNS = ("order", "function", "params", "enabled")


@dataclass(frozen=True)
class StepSpec:
    row: int
    order: float
    function: str | Callable[..., Any]
    params: dict[str, Any]
    comments: str | None = None


@dataclass(frozen=True)
class Event:
    step: StepSpec
    index: int
    total: int
    state: str  # started, writing, completed
    seconds: float = 0.0
    result: Any = None
    rows: int | None = None
    """Of a sheet, the rows written so far, while ``writing``; ``of`` is their number."""
    of: int | None = None


def as_rows(source: Any) -> list[dict[str, Any]]:
    """Rows of a Spark or pandas table, or of any iterable of dictionaries."""
    if isinstance(source, DataFrame):
        return [r.asDict() for r in source.collect()]
    if hasattr(source, "to_dict"):
        return source.to_dict("records")
    return [dict(r) for r in source]


def _missing(v: Any) -> bool:
    return v is None or (isinstance(v, float) and v != v) or (isinstance(v, str) and not v.strip())


def parse_params(value: Any, row: int) -> dict[str, Any]:
    if _missing(value):
        return {}
    if isinstance(value, dict):
        return value
    try:
        found = json.loads(value, strict=False)
    except (TypeError, ValueError) as e:
        raise RuleError(f"row {row}: params is no JSON: {e}") from e
    if not isinstance(found, dict):
        raise RuleError(f"row {row}: params must be a JSON object")
    return found


def read_schedule(source: Any) -> list[StepSpec]:
    """The enabled steps in order. All rows are checked; the first data row is row 2, as in a sheet."""
    rows = as_rows(source)
    names = set().union(*map(set, rows)) if rows else set(COLUMNS)
    lacking = [c for c in COLUMNS if c not in names]
    if lacking:
        raise RuleError(f"the schedule lacks {lacking}")
    orders: dict[float, int] = {}
    out = []
    for row, r in enumerate(rows, 2):
        order, flag = r.get("order"), r.get("enabled")
        if isinstance(order, bool) or not isinstance(order, (int, float)) or order != order:
            raise RuleError(f"row {row}: order must be a number")
        if order in orders:
            raise RuleError(f"row {row}: order {order} is already in row {orders[order]}")
        orders[order] = row
        mark = "" if _missing(flag) else str(flag).strip().upper()
        if mark not in ("", "Y", "N"):
            raise RuleError(f"row {row}: enabled is Y, N or blank, not {flag!r}")
        if mark == "Y":
            if _missing(r.get("function")):
                raise RuleError(f"row {row}: the function is blank")
            name = r["function"]
            out.append(StepSpec(row, float(order), name if callable(name) else str(name).strip(), parse_params(r.get("params"), row), None if _missing(r.get("comments")) else str(r["comments"])))
    return sorted(out, key=lambda s: s.order)


class Pipeline:
    def __init__(self, source: Any) -> None:
        self.steps = read_schedule(source)

    def preview(self) -> list[StepSpec]:
        """The steps that would run; names and parameters are resolved, nothing is read."""
        for s in self.steps:
            bind(resolve(s.function), s.params)
        return self.steps

    def run(self, spark: SparkSession, on_event: Callable[[Event], None] | None = None, reuse: bool = True) -> list[Any]:
        """Run all steps; the first error stops, results of earlier steps stay."""
        self.preview()
        store, done = Store(spark, reuse=reuse), []
        tell = on_event or (lambda e: None)
        for i, s in enumerate(self.steps, 1):
            tell(Event(s, i, len(self.steps), "started"))
            began = time.monotonic()
            store.on_rows = lambda n, of, s=s, i=i: tell(Event(s, i, len(self.steps), "writing", time.monotonic() - began, None, n, of))  # noqa: B023
            done.append(call(resolve(s.function), store, s.params))
            tell(Event(s, i, len(self.steps), "completed", time.monotonic() - began, done[-1]))
        return done


def run_step(spark: SparkSession, function: str | Callable[..., Any], params: dict[str, Any] | None = None) -> Any:
    f, params = resolve(function), params or {}
    bind(f, params)
    return call(f, Store(spark), params)


def known_steps() -> Iterable[str]:
    return sorted(STEPS)
