"""Queries that run the steps themselves, from stored tables to stored tables, as a schedule does, with their SQL.

Tables in between lie in a folder of their own under the shared checkpoint folder.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.errors import RuleError
from ruleframe.plans import allocation
from ruleframe.plans.pipeline import Pipeline, run_step
from ruleframe.queries import steps
from ruleframe.session import ship, table
from ruleframe.storage import workspace

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


class _Tables:
    """Stored inputs and outputs of one query."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d, self.folder = ship(spark), d, workspace(spark)

    def given(self, name: str) -> str:
        return f"{self.d}/{name}.parquet"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def put(self, name: str, df: DataFrame) -> str:
        df.write.parquet(self.path(name))
        return self.path(name)

    def rows(self, name: str, rows: list[dict[str, Any]]) -> str:
        """A small rule table."""
        names = list(dict.fromkeys(k for r in rows for k in r))
        kind = lambda n: "double" if any(isinstance(r.get(n), (int, float)) for r in rows) else "string"
        number = lambda v: float(v) if isinstance(v, (int, float)) else v
        return self.put(name, self.spark.createDataFrame([tuple(number(r.get(n)) for n in names) for r in rows], ", ".join(f"`{n}` {kind(n)}" for n in names)))

    def run(self, step: str, **params: Any) -> DataFrame:
        return self.spark.read.parquet(run_step(self.spark, step, params))


@_register(steps.ORACLE["filter_compare"])
def step_filter_by_conditions(spark: SparkSession, d: str) -> DataFrame:
    t = _Tables(spark, d)
    conditions = {"l_quantity": {"ge": 10, "lt": 30}, "l_discount": {"le": 0.05}, "l_tax": {"gt": 0.01}, "l_returnflag": {"ne": "N"}, "l_linestatus": "F"}
    return t.run("filter_by_conditions", input_file_path=t.given("lineitem"), conditions=conditions, output_file_path=t.path("out")).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@_register("SELECT entity, currency, round(sum(coalesce(amount, 0)), 3) AS amount, round(sum(coalesce(amount2, 0)), 3) AS amount2 FROM detail WHERE is_base = 'Y' GROUP BY 1, 2")
def step_filter_group_sum(spark: SparkSession, d: str) -> DataFrame:
    """Filtered, grouped, and checked for conservation before it takes its place."""
    t = _Tables(spark, d)
    sums = {"sum_by": ["amount", "amount2"], "group_by": ["entity", "currency"], "abs_delta": 1}
    done = t.run("filter_group_sum_to_excel", input_file_path=t.given("detail"), output_file_path=t.path("out"), conditions={"is_base": "Y"}, group_sum_params=sums)
    return done.withColumns({c: F.round(c, 3) for c in ("amount", "amount2")})


@_register(steps.ORACLE["assign_constants"])
def step_assign_columns(spark: SparkSession, d: str) -> DataFrame:
    t = _Tables(spark, d)
    return t.run("assign_columns", input_file_path=t.given("customer"), column_values={"c_name": "EUR", "batch": 7, "checked": True}, output_file_path=t.path("out"))


@_register(steps.ORACLE["standardize_fields"])
def step_standardize_columns(spark: SparkSession, d: str) -> DataFrame:
    t = _Tables(spark, d)
    return t.run("standardize_columns", input_file_path=t.given("customer"), config_file_path=t.rows("rules", steps._STANDARD), field_name="src", output_file_path=t.path("out"))


@_register("SELECT detail_id, 'amount' AS measure, amount AS value FROM detail UNION ALL SELECT detail_id, 'amount2', amount2 FROM detail")
def step_unpivot(spark: SparkSession, d: str) -> DataFrame:
    t = _Tables(spark, d)
    return t.run("unpivot", input_file_path=t.given("detail"), unpivot_columns=["amount", "amount2"], variable_column="measure", value_column="value", output_file_path=t.path("out")).select("detail_id", "measure", "value")


@_register("SELECT r_regionkey, r_name, NULL::INTEGER AS n_nationkey, NULL::VARCHAR AS n_name, NULL::INTEGER AS n_regionkey, 'regions' AS src FROM region UNION ALL SELECT NULL, NULL, n_nationkey, n_name, n_regionkey, 'nations' FROM nation")
def step_concat(spark: SparkSession, d: str) -> DataFrame:
    t = _Tables(spark, d)
    return t.run("concat", input_file_paths=[t.given("region"), t.given("nation")], output_file_path=t.path("out"), source_column="src", source_values=["regions", "nations"])


@_register("SELECT detail_id, currency, amount FROM detail WHERE currency IS DISTINCT FROM 'EUR' UNION ALL SELECT detail_id, currency, amount * 2 FROM detail WHERE currency = 'EUR' AND amount IS NOT NULL")
def step_append_with_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """One partition of a stored table replaced; the rows of all others stay."""
    t = _Tables(spark, d)
    detail = table(spark, d, "detail").select("detail_id", "currency", "amount")
    stored = t.put("stored", detail)
    upload = t.put("upload", detail.where("currency = 'EUR' and amount is not null").withColumn("amount", F.col("amount") * 2))
    return t.run("append_with_overwrite", database_file_path=stored, upload_file_path=upload, overwrite_conditions={"currency": "EUR"})


@_register(steps.ORACLE["attribute_enrichment"])
def step_merge_dims_attribute(spark: SparkSession, d: str) -> DataFrame:
    t = _Tables(spark, d)
    facts = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    relations = {"n_name": {"dimension": "nation", "attributes": {"element_name": "nation_text", "parent": "region"}}}
    return t.run("merge_dims_attribute", input_file_path=t.put("facts", facts), metadata_file_path=t.put("members", steps._members(spark, d)), relations=relations, output_file_path=t.path("out"))


@_register(steps.ORACLE["member_check"])
def step_check_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The step refuses facts that violate the metadata and leaves them, with their reasons, where it was told."""
    t = _Tables(spark, d)
    k = F.col("c_custkey")
    wrong = F.when(k % 10 == 0, "ASIA").when(k % 11 == 0, "").when(k % 13 == 0, None).when(k % 17 == 0, "reg{X}").otherwise(F.col("n_name"))
    facts = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", wrong.alias("nation"))
    try:
        return t.run("check_metadata", input_file_path=t.put("facts", facts), metadata_file_path=t.put("members", steps._members(spark, d)), output_file_path=t.path("out"))
    except RuleError:
        return t.spark.read.parquet(t.path("out"))


@_register(steps.ORACLE["map_layered"])
def step_mapping_1t(spark: SparkSession, d: str) -> DataFrame:
    t = _Tables(spark, d)
    return t.run("mapping_1t", input_file_path=t.put("parts", steps._parts(spark, d)), config_file_path=t.rows("rules", steps._LAYERED), output_file_path=t.path("out")).select("p_partkey", "cls", "tier", "map_trc_tier")


@_register(steps.ORACLE["map_missed"])
def step_mapping_1t_missed(spark: SparkSession, d: str) -> DataFrame:
    """Rows that no rule hits stop the step; they are stored beside its output."""
    t = _Tables(spark, d)
    try:
        return t.run("mapping_1t", input_file_path=t.put("parts", steps._parts(spark, d)), config_file_path=t.rows("rules", steps._BATCHES), output_file_path=t.path("out"))
    except RuleError:
        return t.spark.read.parquet(t.path("out_未命中")).select("p_partkey", "miss_order_execution")


@_register(steps.ORACLE["diff_rows"])
def step_diff_by_row(spark: SparkSession, d: str) -> DataFrame:
    t = _Tables(spark, d)
    first, second = (t.put(n, df) for n, df in zip(("first", "second"), steps._copies(spark, d)))
    return t.run("diff_by_row", first_file_path=first, second_file_path=second, output_file_path=t.path("out"))


@_register(steps.ORACLE["diff_groups"])
def step_diff_by_group(spark: SparkSession, d: str) -> DataFrame:
    t = _Tables(spark, d)
    left, right = (t.put(n, df) for n, df in zip(("left", "right"), steps._copies(spark, d)))
    return t.run("diff_by_group", left_file_path=left, left_groupby=["o_custkey"], left_sum=["price"], right_file_path=right, output_file_path=t.path("out"))


def _allocation(t: _Tables, spark: SparkSession, d: str, **more: Any) -> DataFrame:
    facts = t.put("facts", steps._facts(spark, d).drop("amount2"))
    return t.run("allocation", input_file_path=facts, factor_file_path=t.put("factors", steps._factors(spark)), metadata_file_path=t.put("members", steps._members(spark, d)), output_file_path=t.path("out"), value_columns="amount", **more)


@_register(steps.ORACLE["allocate_service"])
def step_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Allocated by factors over the members, and checked to sum to zero before it takes its place."""
    done = _allocation(_Tables(spark, d), spark, d, keep_label=True, factor_query={"rate": {"gt": 0}})
    return done.drop(allocation.TRACE).withColumn("amount", F.round("amount", 4))


@_register(steps.ORACLE["factor_expand"])
def step_allocation_factors(spark: SparkSession, d: str) -> DataFrame:
    """The expanded factors as the step stores them."""
    t = _Tables(spark, d)
    _allocation(t, spark, d, factor_output_file_path=t.path("expanded"))
    return t.spark.read.parquet(t.path("expanded"))


@_register("""WITH f AS (SELECT n_name AS nation, sum(l_extendedprice) AS amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT nation, segment, round(amount * share, 3) AS amount FROM f, (VALUES ('BUILDING', 0.2), ('MACHINERY', 0.8)) AS x(segment, share) UNION ALL SELECT nation, NULL, round(0.0 - amount, 3) FROM f""")
def step_allocation_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Facts summed by nation before they are allocated from one pool."""
    t = _Tables(spark, d)
    factors = [(None, None, "BUILDING", 1.0), (None, None, "MACHINERY", 4.0)]
    done = t.run("allocation", input_file_path=t.put("facts", steps._facts(spark, d).drop("amount2")), factor_file_path=t.put("factors", steps._factors(spark, factors).drop("out_flag")), metadata_file_path=t.put("members", steps._members(spark, d)), output_file_path=t.path("out"), value_columns=["amount"], group_by=["nation"])
    return done.withColumn("amount", F.round("amount", 3))


@_register("SELECT * FROM (VALUES ('filter_group_sum_to_excel', TRUE, 3), ('allocation', TRUE, 3)) AS x(step, refused, rows_kept)")
def step_conservation(spark: SparkSession, d: str) -> DataFrame:
    """A tolerance below zero that no sum can keep: the steps refuse, and the stored table stays as it was."""
    found = []
    for name in ("filter_group_sum_to_excel", "allocation"):
        t = _Tables(spark, d)
        t.put("out", t.spark.range(3))
        try:
            if name == "allocation":
                _allocation(t, spark, d, abs_delta=-1)
            else:
                t.run(name, input_file_path=t.given("detail"), output_file_path=t.path("out"), group_sum_params={"sum_by": ["amount"], "group_by": ["entity"], "abs_delta": -1})
            refused = False
        except RuleError:
            refused = True
        found.append((name, refused, t.spark.read.parquet(t.path("out")).count()))
    return spark.createDataFrame(found, "step string, refused boolean, rows_kept int")


@_register(steps.ORACLE["sql_join_agg"])
def step_query_sql(spark: SparkSession, d: str) -> DataFrame:
    t = _Tables(spark, d)
    sql = f"SELECT n_name, CAST(count(*) AS BIGINT) AS n_orders, round(sum(o_totalprice), 4) AS total FROM read_parquet('{t.given('orders')}') JOIN read_parquet('{t.given('customer')}') ON o_custkey = c_custkey JOIN read_parquet('{t.given('nation')}') ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name HAVING count(*) > 1"
    return t.run("query_sql", sql=sql, output_file_path=t.path("out"))


@_register("""SELECT entity, measure, round(sum(coalesce(value, 0)), 3) AS value, 'closed' AS state FROM (SELECT entity, 'amount' AS measure, amount AS value FROM detail WHERE period IN ('202401', '202402') UNION ALL SELECT entity, 'amount2', amount2 FROM detail WHERE period IN ('202401', '202402')) GROUP BY 1, 2""")
def step_schedule(spark: SparkSession, d: str) -> DataFrame:
    """A whole schedule: filter, unpivot, group with a check, mark; one row is switched off."""
    t = _Tables(spark, d)
    a, b, c, e = (t.path(n) for n in ("filtered", "long", "summed", "out"))
    rows = [
        {"order": 30, "function": "service.filter_group_sum_to_excel", "params": {"input_file_path": b, "output_file_path": c, "group_sum_params": {"sum_by": ["value"], "group_by": ["entity", "measure"], "abs_delta": 1}}, "enabled": "Y"},
        {"order": 10, "function": "service.filter_by_conditions", "params": {"input_file_path": t.given("detail"), "conditions": {"period": {"in": ["202401", "202402"]}}, "output_file_path": a}, "enabled": "y"},
        {"order": 20, "function": "unpivot", "params": {"input_file_path": a, "unpivot_columns": ["amount", "amount2"], "variable_column": "measure", "value_column": "value", "output_file_path": b}, "enabled": "Y"},
        {"order": 35, "function": "assign_columns", "params": {"input_file_path": c, "column_values": {"state": "open"}, "output_file_path": c}, "enabled": "N"},
        {"order": 40.5, "function": "assign_columns", "params": {"input_file_path": c, "column_values": {"state": "closed"}, "output_file_path": e}, "enabled": "Y"},
    ]
    Pipeline(rows).run(t.spark)
    return t.spark.read.parquet(e).withColumn("value", F.round("value", 3))
