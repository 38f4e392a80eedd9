"""The catalogue of steps a schedule can name. Each builds a lazy table from tables; reading and writing is the runner's."""

from __future__ import annotations

import inspect
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ruleframe.errors import RuleError
from ruleframe.operators import diff, joins, quality, table, unify
from ruleframe.plans import allocation, mapping
from ruleframe.sources import tables
from ruleframe.sources.xlsx import write_diff


@dataclass
class Store:
    """Tables by path. A table written by one step is read by later ones as its plan, not from disk."""

    spark: SparkSession
    made: dict[str, DataFrame] = field(default_factory=dict)
    reuse: bool = False
    on_rows: Callable[[int, int | None], None] | None = None
    """Called with the rows written to a sheet so far and their number."""

    def read(self, path: str, sheet: str | None = None) -> DataFrame:
        key = tables.qualified(self.spark, path)
        return self.made[key] if self.reuse and key in self.made else tables.read_table(self.spark, path, sheet)

    def write(self, df: DataFrame, path: str, captions: dict[str, str] | None = None, verify: Callable[[], None] | None = None, sheet: str | None = None) -> str:
        tables.write_table(df, path, sheet, captions, verify, self.on_rows)
        if self.reuse and not path.lower().endswith(".xlsx"):
            self.made[tables.qualified(self.spark, path)] = tables.read_table(self.spark, path)
        return path


STEPS: dict[str, Callable[..., Any]] = {}


def step(f: Callable[..., Any]) -> Callable[..., Any]:
    STEPS[f.__name__] = f
    return f


def register(f: Callable[..., Any], name: str | None = None) -> Callable[..., Any]:
    """Make a function a step of schedules under its own or the given (perhaps dotted) name. A first parameter called
    ``store`` gets the run's tables; all others come from the schedule."""
    name = name or f.__name__
    if STEPS.get(name, f) is not f:
        raise RuleError(f"there already is a step {name!r}")
    STEPS[name] = f
    return f


# Names, parameters and defaults of the steps below are those that schedules use.


@step
def filter_by_conditions(store: Store, input_file_path: str, conditions: dict | str, output_file_path: str, input_sheet_name: str | None = None) -> str:
    return store.write(table.filter_rows(store.read(input_file_path, input_sheet_name), conditions), output_file_path)


@step
def filter_group_sum_to_excel(store: Store, input_file_path: str, output_file_path: str, field_mapping_file_path: str | None = None, field_mapping_sheet_name: str | None = None, conditions: dict | str | None = None, group_sum_params: dict[str, Any] | None = None, input_sheet_name: str | None = None, output_sheet_name: str | None = None) -> str:
    df, verify = store.read(input_file_path, input_sheet_name), None
    if conditions is not None:
        df = table.filter_rows(df, conditions)
    if group_sum_params is not None:
        p = dict(group_sum_params)
        delta, sums = p.pop("abs_delta", 0.2), p.pop("sum_by", None)
        exclude = p.pop("group_by_exclude", None)
        if sums:
            df, verify = table.group_sum_checked(df, sums, p.pop("group_by", None), exclude, delta)
        else:
            df = table.group_sum(df, None, p.pop("group_by", None), exclude)
    named = tables.captions(store.read(field_mapping_file_path, field_mapping_sheet_name)) if field_mapping_file_path else None
    return store.write(df, output_file_path, named, verify, output_sheet_name)


@step
def assign_columns(store: Store, input_file_path: str, column_values: dict[str, Any], output_file_path: str, input_sheet_name: str | None = None) -> str:
    return store.write(table.assign(store.read(input_file_path, input_sheet_name), column_values), output_file_path)


@step
def standardize_columns(store: Store, input_file_path: str, config_file_path: str, field_name: str, output_file_path: str, input_sheet_name: str | None = None, config_sheet_name: str | None = None) -> str:
    rules = [r.asDict() for r in store.read(config_file_path, config_sheet_name).collect()]
    return store.write(table.standardize(store.read(input_file_path, input_sheet_name), rules, field_name), output_file_path)


@step
def unpivot(store: Store, input_file_path: str, unpivot_columns: list[str], variable_column: str, value_column: str, output_file_path: str, input_sheet_name: str | None = None) -> str:
    return store.write(table.unpivot(store.read(input_file_path, input_sheet_name), unpivot_columns, variable_column, value_column), output_file_path)


@step
def concat(store: Store, input_file_paths: list[str], output_file_path: str, input_sheet_names: list[str | None] | None = None, source_column: str | None = None, source_values: list | None = None) -> str:
    sheets = input_sheet_names or [None] * len(input_file_paths)
    if len(sheets) != len(input_file_paths):
        raise RuleError("there must be one sheet name a file")
    return store.write(unify.concat([store.read(p, s) for p, s in zip(input_file_paths, sheets)], source_column, source_values), output_file_path)


@step
def append_with_overwrite(store: Store, database_file_path: str, upload_file_path: str, overwrite_conditions: dict | str, database_sheet_name: str | None = None, upload_sheet_name: str | None = None) -> str:
    database = store.read(database_file_path, database_sheet_name) if tables.exists(store.spark, database_file_path) else None
    return store.write(unify.replace_partition(database, store.read(upload_file_path, upload_sheet_name), overwrite_conditions), database_file_path, sheet=database_sheet_name)


@step
def merge_dims_attribute(store: Store, input_file_path: str, metadata_file_path: str, relations: dict | str, output_file_path: str, input_sheet_name: str | None = None, metadata_sheet_name: str | None = None) -> str:
    return store.write(joins.enrich(store.read(input_file_path, input_sheet_name), store.read(metadata_file_path, metadata_sheet_name), relations), output_file_path)


@step
def check_metadata(store: Store, input_file_path: str, metadata_file_path: str, output_file_path: str, input_sheet_name: str | None = None, metadata_sheet_name: str | None = None) -> str:
    members = store.read(metadata_file_path, metadata_sheet_name)
    faults = quality.check_metadata(members).limit(10).collect()
    if faults:
        raise RuleError(f"the metadata have faults: {[tuple(r) for r in faults]}")
    found = quality.check_members(store.read(input_file_path, input_sheet_name), members)
    store.write(found, output_file_path)
    n = store.read(output_file_path).count()
    if n:
        raise RuleError(f"{n} values violate the metadata; see {output_file_path}")
    return output_file_path


@step
def mapping_1t(store: Store, input_file_path: str, config_file_path: str, output_file_path: str, input_sheet_name: str | None = None, config_sheet_name: str | None = None) -> str:
    mapped = mapping.map_table(store.read(input_file_path, input_sheet_name), store.read(config_file_path, config_sheet_name))
    if mapped.missed.limit(1).count():
        stem, end = os.path.splitext(output_file_path)
        where = store.write(mapped.missed, f"{stem}_未命中.xlsx" if end.lower() == ".xlsx" else f"{stem}_未命中{end}")
        raise RuleError(f"some rows are hit by no rule; see {where}")
    return store.write(mapped.result, output_file_path)


@step
def diff_by_row(store: Store, first_file_path: str, second_file_path: str, output_file_path: str, check_columns: list[str] | None = None, exclude_columns: list[str] | None = None, column_map: dict[str, str] | None = None, diff_source_col: str = "_tmp_diff_src", first_sheet_name: str | None = None, second_sheet_name: str | None = None, output_sheet_name: str | None = None) -> str:
    pair = store.read(first_file_path, first_sheet_name), store.read(second_file_path, second_sheet_name)
    return store.write(diff.diff_rows(*pair, check_columns, exclude_columns, column_map, diff_source_col), output_file_path, sheet=output_sheet_name)


@step
def diff_by_row_to_excel(store: Store, first_file_path: str, second_file_path: str, output_file_path: str, join_keys: list[str], output_sheet_name: str = "差异明细", check_columns: list[str] | None = None, exclude_columns: list[str] | None = None, column_map: dict[str, str] | None = None, diff_source_col: str = "_tmp_diff_src", first_sheet_name: str | None = None, second_sheet_name: str | None = None) -> str:
    pair = store.read(first_file_path, first_sheet_name), store.read(second_file_path, second_sheet_name)
    reported = diff.report(diff.diff_rows(*pair, check_columns, exclude_columns, column_map, diff_source_col), join_keys, diff_source_col)
    return write_diff(reported, tables.local(store.spark, output_file_path), output_sheet_name)


@step
def diff_by_group(store: Store, left_file_path: str, left_groupby: list[str], left_sum: list[str], right_file_path: str, output_file_path: str, right_groupby: list[str] | None = None, right_sum: list[str] | None = None, keep_groupby: str = "left", abs_delta: float = 0.5, left_sheet_name: str | None = None, right_sheet_name: str | None = None, output_sheet_name: str | None = None) -> str:
    pair = store.read(left_file_path, left_sheet_name), store.read(right_file_path, right_sheet_name)
    return store.write(diff.diff_groups(pair[0], left_groupby, left_sum, pair[1], right_groupby, right_sum, keep_groupby, abs_delta), output_file_path, sheet=output_sheet_name)


@step
def allocate(store: Store, input_file_path: str, factor_file_path: str, metadata_file_path: str, output_file_path: str, value_columns: str | list[str], input_sheet_name: str | None = None, factor_sheet_name: str | None = None, metadata_sheet_name: str | None = None, output_sheet_name: str | None = None, rate_column: str = "rate", out_prefix: str = "out_", in_prefix: str = "in_", dimension_column: str = "dimension", element_column: str = "element_code", base_flag_column: str = "is_base", parent_column: str = "parent", base_flag_value: str = "Y", keep_label: bool = False, group_by: list[str] | None = None, group_by_exclude: list[str] | None = None, abs_delta: float = 5, factor_output_file_path: str | None = None, factor_output_sheet_name: str | None = None, factor_query: dict | str | None = None, assign_result: dict[str, Any] | None = None) -> str:
    values = [value_columns] if isinstance(value_columns, str) else list(value_columns)
    facts, members = store.read(input_file_path, input_sheet_name), store.read(metadata_file_path, metadata_sheet_name)
    factors = store.read(factor_file_path, factor_sheet_name)
    if factor_query:
        factors = table.filter_rows(factors, factor_query)
    factors = allocation.expand_factors(factors, members, out_prefix, dimension=dimension_column, code=element_column, is_base=base_flag_column, parent=parent_column, base_flag=base_flag_value)
    if factor_output_file_path:
        store.write(factors, factor_output_file_path, sheet=factor_output_sheet_name)
    result = allocation.allocate(facts, factors, None, values, rate_column, out_prefix, in_prefix, keep_label, group_by, group_by_exclude, assign_result=assign_result)
    watched, verify = allocation.conserved(result, values, abs_delta)
    return store.write(watched, output_file_path, None, verify, output_sheet_name)


@step
def query_sql(store: Store, sql: str, output_file_path: str) -> str:
    return store.write(tables.query(store.spark, sql), output_file_path)


STEPS["allocation"] = STEPS.pop("allocate")


#: Modules under which schedules name the steps above.
_MODULES = ("service", "steps")


def resolve(name: str | Callable[..., Any]) -> Callable[..., Any]:
    """A step by its name, or by a dotted path into the module of steps; other paths must be registered. A function
    stands for itself."""
    if callable(name):
        return name
    given = str(name).strip()
    found = STEPS.get(given)
    if found is None:
        module, _, last = given.rpartition(".")
        found = STEPS.get(last) if module.rpartition(".")[2] in _MODULES else None
    if found is None:
        raise RuleError(f"there is no step {name!r}; known: {sorted(STEPS)}")
    return found


def _takes_store(f: Callable[..., Any]) -> bool:
    return next(iter(inspect.signature(f).parameters), None) == "store"


def bind(f: Callable[..., Any], params: dict[str, Any]) -> None:
    try:
        inspect.signature(f).bind(*([None] if _takes_store(f) else []), **params)
    except TypeError as e:
        raise RuleError(f"{getattr(f, '__name__', f)}: {e}") from e


def call(f: Callable[..., Any], store: Store, params: dict[str, Any]) -> Any:
    return f(*([store] if _takes_store(f) else []), **params)
