"""Queries of the rule-table operators over the star-schema tables, with their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.functions.columns import blank
from ruleframe.operators import diff, hierarchy, joins, quality, unify
from ruleframe.operators import table as tab
from ruleframe.plans import allocation, mapping
from ruleframe.queries import core as core_sql
from ruleframe.session import ship, table
from ruleframe.sources.tables import query

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS x({names}))"


# ---- filters

_EVENTS = "SELECT event_id, user_id, value, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '  ' ELSE event_type END AS event_type FROM events"


def _events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, "  ").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", "user_id", "value", kind.alias("event_type"))


@_register("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30 AND l_discount <= 0.05 AND l_tax > 0.01 AND l_returnflag <> 'N' AND l_linestatus = 'F'")
def filter_compare(spark: SparkSession, d: str) -> DataFrame:
    conditions = {"l_quantity": {"ge": 10, "lt": 30}, "l_discount": {"le": 0.05}, "l_tax": {"gt": 0.01}, "l_returnflag": {"ne": "N"}, "l_linestatus": "F"}
    return tab.filter_rows(table(spark, d, "lineitem"), conditions).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@_register("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_quantity NOT IN (1, 2, 3)")
def filter_membership(spark: SparkSession, d: str) -> DataFrame:
    rows = tab.filter_rows(table(spark, d, "lineitem"), json.dumps({"l_returnflag": {"in": ["R", "A", None]}, "l_quantity": {"not_in": [1, 2, 3, None]}}))
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


@_register("SELECT p_partkey, p_name, p_type, p_brand FROM part WHERE contains(p_brand, '#1') AND starts_with(p_type, 'E') AND ends_with(CAST(p_partkey AS VARCHAR), '7')")
def filter_text(spark: SparkSession, d: str) -> DataFrame:
    rows = tab.filter_rows(table(spark, d, "part"), {"p_brand": {"contains": "#1"}, "p_type": {"starts_with": "E"}, "p_partkey": {"ends_with": "7"}})
    return rows.select("p_partkey", "p_name", "p_type", "p_brand")


@_register(f"SELECT event_id, value FROM ({_EVENTS}) WHERE event_type IS NULL AND user_id IS NOT NULL")
def filter_nulls(spark: SparkSession, d: str) -> DataFrame:
    return tab.filter_rows(_events(spark, d), {"event_type": {"is_null": True}, "user_id": {"is_null": False, "ne": None}}).select("event_id", "value")


@_register("SELECT detail_id, currency, element_code, amount FROM detail WHERE trim(currency) <> '' AND trim(element_code) <> '' AND amount IS NOT NULL")
def drop_empty_any(spark: SparkSession, d: str) -> DataFrame:
    return tab.drop_empty(table(spark, d, "detail").select("detail_id", "currency", "element_code", "amount"), ["currency", "element_code", "amount"])


@_register(f"SELECT * FROM (SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM ({_EVENTS})) WHERE trim(event_type) <> '' OR value IS NOT NULL")
def drop_empty_all(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return tab.drop_empty(rows, ["event_type", "value"], "all")


# ---- projections


@_register("SELECT c_custkey, 'EUR' AS c_name, c_nationkey, c_acctbal, c_mktsegment, 7 AS batch, TRUE AS checked FROM customer")
def assign_constants(spark: SparkSession, d: str) -> DataFrame:
    return tab.assign(table(spark, d, "customer"), {"c_name": "EUR", "batch": 7, "checked": True})


_STANDARD = [
    {"standard": "segment", "src": "c_mktsegment", "dtype": "string"},
    {"standard": "balance", "src": "c_acctbal", "dtype": "float"},
    {"standard": "region_code", "src": None, "dtype": None},
    {"standard": "customer", "src": "c_custkey", "dtype": "string"},
]


@_register("SELECT c_mktsegment AS segment, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS region_code, CAST(c_custkey AS VARCHAR) AS customer FROM customer")
def standardize_fields(spark: SparkSession, d: str) -> DataFrame:
    return tab.standardize(table(spark, d, "customer"), _STANDARD, "src")


_LINE = "SELECT l_linestatus, l_returnflag, sum(l_quantity) AS l_quantity, sum(l_tax) AS l_tax, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL"


@_register(f"SELECT l_linestatus, l_returnflag, measure, round(amount, 4) AS amount FROM ({_LINE}) UNPIVOT INCLUDE NULLS (amount FOR measure IN (l_quantity, l_tax, n))")
def unpivot_measures(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.sum("l_quantity").alias("l_quantity"), F.sum("l_tax").alias("l_tax"), F.count("*").alias("n"))
    return tab.unpivot(wide, ["l_quantity", "l_tax", "n"], "measure", "amount").withColumn("amount", F.round("amount", 4))


@_register("SELECT o_orderkey AS o_orderstatus, o_custkey, o_totalprice FROM orders")
def rename_over(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return tab.rename_over(orders, {"o_orderkey": "o_orderstatus", "nothing": "x"})


@_register("SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS F, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    long = tab.group_sum(table(spark, d, "lineitem"), ["l_quantity"], ["l_returnflag", "l_linestatus"])
    return tab.pivot_first(long, ["l_returnflag"], "l_linestatus", "l_quantity", ["F", "O"])


# ---- grouping and unions


@_register("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, round(sum(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def group_sum_whitelist(spark: SparkSession, d: str) -> DataFrame:
    sums = tab.group_sum(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus"])
    return sums.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@_register("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1, 2")
def group_sum_blacklist(spark: SparkSession, d: str) -> DataFrame:
    sums = tab.group_sum(table(spark, d, "orders"), ["o_totalprice"], exclude=["o_orderkey", "o_custkey", "o_orderdate"])
    return sums.withColumn("o_totalprice", F.round("o_totalprice", 4))


@_register("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def group_distinct(spark: SparkSession, d: str) -> DataFrame:
    return tab.group_sum(table(spark, d, "orders"), None, ["o_orderstatus", "o_orderpriority"])


@_register("SELECT o_orderkey, o_totalprice, CAST(o_custkey AS VARCHAR) AS o_custkey, 'open' AS src FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, o_totalprice, o_orderpriority, 'done' FROM orders WHERE o_orderstatus <> 'O'")
def concat_tagged(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    a = orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice", "o_custkey")
    b = orders.where("o_orderstatus <> 'O'").select(F.col("o_orderpriority").alias("o_custkey"), "o_orderkey", "o_totalprice")
    return unify.concat([a, b], "src", ["open", "done"])


@_register("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT -o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0")
def replace_partition(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    upload = orders.where("o_orderstatus = 'F' and o_orderkey % 2 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))
    return unify.replace_partition(orders, upload, {"o_orderstatus": "F"})


# ---- joins


@_register("SELECT s_suppkey, s_name, s_nationkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def left_join_validated(spark: SparkSession, d: str) -> DataFrame:
    return joins.merge_left(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), table(spark, d, "nation"), ["s_nationkey"], ["n_nationkey"])


@_register("SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE c_name END AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_join_fill_missing(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise(F.when(F.col("c_custkey") % 2 == 0, "")).alias("label"))
    right = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("label"))
    return joins.merge_left(left, right, ["c_nationkey"], ["n_nationkey"], if_duplicate="keep_right_if_left_isnull")


def _members(spark: SparkSession, d: str) -> DataFrame:
    """World, regions and nations as one dimension."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    row = lambda c, p, b: [F.lit("nation").alias("dimension"), c.alias("element_code"), F.concat(F.lit("name of "), c).alias("element_name"), F.lit(b).alias("is_base"), p.cast("string").alias("parent")]
    world = region.limit(1).select(*row(F.lit("WORLD"), F.lit(None), "N"))
    regions = region.select(*row(F.col("r_name"), F.lit("WORLD"), "N"))
    nations = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(*row(F.col("n_name"), F.col("r_name"), "Y"))
    return world.unionByName(regions).unionByName(nations)


_MEMBERS = """member AS (SELECT 'WORLD' AS element_code, CAST(NULL AS VARCHAR) AS parent, 'N' AS is_base
  UNION ALL SELECT r_name, 'WORLD', 'N' FROM region UNION ALL SELECT n_name, r_name, 'Y' FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@_register("SELECT s_suppkey, n_name, 'name of ' || n_name AS nation_text, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def attribute_enrichment(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    relations = {"n_name": {"dimension": "nation", "attributes": {"element_name": "nation_text", "parent": "region"}}}
    return joins.enrich(facts, _members(spark, d), relations)


@_register("SELECT o_orderkey AS pid, o_totalprice AS price, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders")
def wide_by_pid(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    parts = [orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("pid"), F.col("o_totalprice").alias("price")), orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("pid"), F.col("o_totalprice").alias("price")), orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("pid"), F.col("o_orderstatus").alias("status"))]
    return joins.assemble_by_pid(parts)[1]


# ---- reconciliations

_COPY = """SELECT CASE WHEN o_orderkey % 103 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus,
  CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS price FROM orders WHERE o_orderkey % 101 <> 0"""
_FIRST = "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders"


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.floor("o_totalprice").cast("long").alias("price"))
    key = F.col("o_orderkey")
    changed = orders.where(key % 101 != 0).withColumns({"price": F.col("price") + F.when(key % 97 == 0, 1).otherwise(0), "o_orderkey": F.when(key % 103 == 0, F.lit(0) - key).otherwise(key)})
    return orders, changed


_ONCE = f"""b AS (SELECT *, 'df_1' AS _tmp_diff_src FROM ({_FIRST}) UNION ALL SELECT *, 'df_2' FROM ({_COPY})),
o AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, CAST(price AS VARCHAR) AS price, _tmp_diff_src,
  count(*) OVER (PARTITION BY o_orderkey, o_custkey, o_orderstatus, price) AS n FROM b)"""


@_register(f"WITH {_ONCE} SELECT * EXCLUDE (n) FROM o WHERE n = 1")
def diff_rows(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_rows(*_copies(spark, d))


@_register(f"""WITH {_ONCE}, l AS (SELECT * FROM o WHERE n = 1 AND _tmp_diff_src = 'df_1'), r AS (SELECT * FROM o WHERE n = 1 AND _tmp_diff_src = 'df_2')
SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, CASE WHEN l.n IS NULL THEN '增' WHEN r.n IS NULL THEN '删' ELSE '改' END AS "差异类型",
  l.price AS "旧_price", r.price AS "新_price", l.o_orderstatus AS "旧_o_orderstatus", r.o_orderstatus AS "新_o_orderstatus", l.o_custkey AS "旧_o_custkey", r.o_custkey AS "新_o_custkey",
  CASE WHEN l.price <> r.price AND l.n = r.n THEN 'price' ELSE '' END AS "变更字段" FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey""")
def diff_report(spark: SparkSession, d: str) -> DataFrame:
    found = diff.report(diff.diff_rows(*_copies(spark, d)), ["o_orderkey"])
    return found.withColumn("变更字段", F.array_join("变更字段", ","))


@_register(f"""WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(sum(price) AS DOUBLE) AS price_left FROM ({_FIRST}) GROUP BY 1),
r AS (SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(sum(price) AS DOUBLE) AS price_right FROM ({_COPY}) GROUP BY 1)
SELECT *, coalesce(price_left, 0) - coalesce(price_right, 0) AS price_diff FROM l FULL JOIN r USING (o_custkey) WHERE abs(coalesce(price_left, 0) - coalesce(price_right, 0)) >= 0.5""")
def diff_groups(spark: SparkSession, d: str) -> DataFrame:
    a, b = _copies(spark, d)
    return diff.diff_groups(a, ["o_custkey"], ["price"], b)


# ---- quality

_FAULTS = [("nation", "ASIA", "again", "N", "WORLD"), ("nation", "LOST", "lost", "Y", "NOWHERE"), ("nation", "BLANK", "  ", "", "WORLD"), ("nation", "FLAG", "flag", "X", "NATION_0"), ("nation", "UNDER", "under", "Y", "LOST")]


@_register(f"""WITH {_MEMBERS}, m AS (SELECT 'nation' AS dimension, element_code, 'name of ' || element_code AS element_name, is_base, parent FROM member
  UNION ALL SELECT * FROM {_values(_FAULTS, 'dimension, element_code, element_name, is_base, parent')}),
g AS (SELECT element_code, count(*) AS n, bool_or(is_base = 'N') AS summary FROM m GROUP BY 1)
SELECT m.dimension, m.element_code, reason FROM m JOIN g ON g.element_code = m.element_code LEFT JOIN g p ON p.element_code = m.parent,
  unnest([CASE WHEN g.n > 1 THEN 'duplicate' END, CASE WHEN trim(element_name) = '' THEN 'name blank' END, CASE WHEN trim(is_base) = '' THEN 'flag blank' END,
    CASE WHEN is_base NOT IN ('Y', 'N', '') THEN 'flag not Y or N' END, CASE WHEN m.parent IS NOT NULL AND p.n IS NULL THEN 'parent missing' END,
    CASE WHEN p.n IS NOT NULL AND NOT p.summary THEN 'parent is base' END]) AS t(reason) WHERE reason IS NOT NULL""")
def metadata_validity(spark: SparkSession, d: str) -> DataFrame:
    more = ship(spark).createDataFrame(_FAULTS, "dimension string, element_code string, element_name string, is_base string, parent string")
    return quality.check_metadata(_members(spark, d).unionByName(more))


@_register("""SELECT c_custkey, nation, 'nation' AS CHECK_DIMENSION, nation AS CHECK_ELEMENT_CODE, CASE WHEN nation IS NULL OR nation = '' THEN 'value is blank' ELSE 'not a base member' END AS REASON
FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'ASIA' WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'reg{X}' ELSE n_name END AS nation
  FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE nation IS NULL OR nation IN ('ASIA', '')""")
def member_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    wrong = F.when(k % 10 == 0, "ASIA").when(k % 11 == 0, "").when(k % 13 == 0, None).when(k % 17 == 0, "reg{X}").otherwise(F.col("n_name"))
    facts = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", wrong.alias("nation"))
    return quality.check_members(facts, _members(spark, d))


# ---- hierarchy and allocation


@_register("SELECT 'nation' AS dimension, r_name AS ancestor, n_name AS base FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'nation', 'WORLD', n_name FROM nation")
def hierarchy_closure(spark: SparkSession, d: str) -> DataFrame:
    return allocation.base_members(_members(spark, d))


@_register(core_sql.TREE + """ SELECT b.d AS dimension, a.c AS ancestor, b.c AS base FROM r b JOIN r a ON a.d = b.d AND a.root = b.root AND starts_with(b.path, a.path || '/')
WHERE NOT EXISTS (SELECT 1 FROM r x JOIN m ON m.d = x.d AND m.c = x.c WHERE m.d = b.d AND m.p = b.c)""")
def hierarchy_closure_members(spark: SparkSession, d: str) -> DataFrame:
    """All members of ``metadata`` that lie in trees, those without children as base members; none of it on the driver."""
    members = table(spark, d, "metadata")
    nodes = hierarchy.build(members).nodes.where("link_state = 'tree'").select("dimension", "element_code", F.when(F.col("n_descendants") == 0, "Y").otherwise("N").alias("is_base"))
    parents = members.where("dimension is not null and element_code is not null").groupBy("dimension", "element_code").agg(F.min(F.when(~blank(F.col("parent")), F.col("parent"))).alias("parent"))
    return allocation.base_members(nodes.join(parents, ["dimension", "element_code"]), on_driver=0)


_FACTORS = [("AFRICA", None, "BUILDING", 1.0), ("AFRICA", None, "MACHINERY", 3.0), ("ASIA", "R", "BUILDING", 2.0), ("ASIA", "R", "MACHINERY", 2.0), ("NATION_3", None, "HOUSEHOLD", 1.0), ("elsewhere", None, "HOUSEHOLD", 5.0)]
_F_NAMES = "out_nation, out_flag, in_segment, rate"
_EXPANDED = f"""{_MEMBERS}, bridge AS (SELECT p.element_code AS ancestor, c.element_code AS base FROM member p JOIN member c ON c.parent = p.element_code AND c.is_base = 'Y'),
f AS (SELECT DISTINCT coalesce(base, out_nation) AS out_nation, out_flag, in_segment, CAST(rate AS DOUBLE) AS rate FROM {_values(_FACTORS, _F_NAMES)} LEFT JOIN bridge ON ancestor = out_nation)"""


def _factors(spark: SparkSession, rows: list[tuple] = _FACTORS) -> DataFrame:
    return ship(spark).createDataFrame(rows, "out_nation string, out_flag string, in_segment string, rate double")


@_register(f"WITH {_EXPANDED} SELECT * FROM f")
def factor_expand(spark: SparkSession, d: str) -> DataFrame:
    return allocation.expand_factors(_factors(spark), _members(spark, d))


@_register(f"""WITH {_MEMBERS}, k AS (SELECT element_code AS code, element_code AS base FROM member WHERE is_base = 'Y' UNION SELECT p.element_code, c.element_code FROM member p JOIN member c ON c.parent = p.element_code AND c.is_base = 'Y'
  UNION SELECT 'WORLD', element_code FROM member WHERE is_base = 'Y')
SELECT DISTINCT base AS out_nation, CAST(NULL AS VARCHAR) AS out_flag, 'BUILDING' AS in_segment, 1.0::DOUBLE AS rate FROM k WHERE regexp_matches(code, '^(NATION_1|AM)')""")
def factor_expand_regex(spark: SparkSession, d: str) -> DataFrame:
    return allocation.expand_factors(_factors(spark, [("reg{NATION_1|AM}", None, "BUILDING", 1.0)]), _members(spark, d))


_FACTS = "facts AS (SELECT n_name AS nation, l_returnflag AS flag, sum(l_extendedprice) AS amount, sum(l_quantity) AS amount2 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return line.groupBy(F.col("n_name").alias("nation"), F.col("l_returnflag").alias("flag")).agg(F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("amount2"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


_NATIONS = {"out_nation": "nation", "in_segment": "segment"}
_BASIC = [("NATION_1", None, "BUILDING", 1.0), ("NATION_1", None, "MACHINERY", 3.0), ("NATION_2", None, "BUILDING", 2.0), ("NATION_2", None, "MACHINERY", 2.0)]
_SHARE = "s AS (SELECT out_nation, in_segment, rate / sum(rate) OVER (PARTITION BY out_nation) AS share FROM (SELECT out_nation, in_segment, sum(rate) AS rate FROM b GROUP BY 1, 2))"


@_register(f"""WITH {_FACTS}, b AS (SELECT * FROM {_values(_BASIC, _F_NAMES)}), {_SHARE}
SELECT nation, flag, CAST(NULL AS VARCHAR) AS segment, round(0.0 - amount, 4) AS amount, round(0.0 - amount2, 4) AS amount2, 'out' AS dim_alclabel FROM facts WHERE nation IN (SELECT out_nation FROM s)
UNION ALL SELECT nation, flag, in_segment, round(amount * share, 4), round(amount2 * share, 4), 'in' FROM facts JOIN s ON nation = out_nation""")
def allocate_basic(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(allocation.allocate_basic(_facts(spark, d), _factors(spark, _BASIC), ["out_nation"], ["in_segment"], ["amount", "amount2"], names=_NATIONS), "amount", "amount2")


@_register(f"""WITH {_FACTS}, b AS (SELECT * FROM {_values(_BASIC, _F_NAMES)}), {_SHARE}
SELECT nation, flag, in_segment AS segment, round(amount * share, 4) AS amount, round(share, 6) AS part FROM facts JOIN s ON nation = out_nation""")
def allocate_share_column(spark: SparkSession, d: str) -> DataFrame:
    done = allocation.allocate_basic(_facts(spark, d).drop("amount2"), _factors(spark, _BASIC), ["out_nation"], ["in_segment"], ["amount"], names=_NATIONS, share_column="part")
    return _rounded(done.where("dim_alclabel = 'in'").drop("dim_alclabel"), "amount").withColumn("part", F.round("part", 6))


@_register(f"""WITH {_FACTS}, hit AS (SELECT *, CASE WHEN nation = 'NATION_1' AND flag = 'A' THEN 1 WHEN nation IN ('NATION_1', 'NATION_2') THEN 2 END AS r FROM facts),
t AS (SELECT * FROM (VALUES (1, 'BUILDING', 1.0), (2, 'BUILDING', 0.25), (2, 'MACHINERY', 0.75)) AS x(r, segment, share))
SELECT nation, flag, segment, round(amount * share, 4) AS amount FROM hit JOIN t USING (r)
UNION ALL SELECT nation, flag, NULL, round(0.0 - amount, 4) FROM hit WHERE r IS NOT NULL
UNION ALL SELECT nation, flag, 'missing', round(amount, 4) FROM hit WHERE r IS NULL""")
def allocate_family(spark: SparkSession, d: str) -> DataFrame:
    one = _factors(spark, [("NATION_1", "A", "BUILDING", 4.0)])
    two = _factors(spark, [(n, None, s, r) for n in ("NATION_1", "NATION_2") for s, r in (("BUILDING", 1.0), ("MACHINERY", 3.0))])
    names = _NATIONS | {"out_flag": "flag"}
    done, missing = allocation.allocate_family(_facts(spark, d).drop("amount2"), [(["out_nation", "out_flag"], ["in_segment"], one), (["out_nation"], ["in_segment"], two)], ["amount"], names=names)
    return _rounded(unify.union_relaxed([done, missing.withColumn("segment", F.lit("missing"))]), "amount")


@_register(f"""WITH {_FACTS} SELECT nation, flag, segment, round(amount * share, 4) AS amount, 'pool' AS source FROM facts, (VALUES ('BUILDING', 0.2), ('MACHINERY', 0.8)) AS x(segment, share)
UNION ALL SELECT nation, flag, NULL, round(0.0 - amount, 4), 'pool' FROM facts""")
def allocate_pool(spark: SparkSession, d: str) -> DataFrame:
    factors = _factors(spark, [(None, None, "BUILDING", 1.0), ("  ", "", "MACHINERY", 4.0)])
    return _rounded(allocation.allocate(_facts(spark, d).drop("amount2"), factors, None, ["amount"], assign_result={"source": "pool"}), "amount")


@_register(f"""WITH {_EXPANDED}, {_FACTS},
s AS (SELECT *, rate / sum(rate) OVER (PARTITION BY out_nation, out_flag) AS share FROM (SELECT out_nation, out_flag, in_segment, sum(rate) AS rate FROM f GROUP BY ALL))
SELECT nation, flag, in_segment AS segment, round(amount * share, 4) AS amount, 'in' AS dim_alclabel FROM facts JOIN s ON nation = out_nation AND (out_flag IS NULL OR out_flag = flag)
UNION ALL SELECT nation, flag, NULL, round(0.0 - amount, 4), 'out' FROM facts JOIN (SELECT DISTINCT out_nation, out_flag FROM s) ON nation = out_nation AND (out_flag IS NULL OR out_flag = flag)""")
def allocate_service(spark: SparkSession, d: str) -> DataFrame:
    done = allocation.allocate(_facts(spark, d).drop("amount2"), _factors(spark), _members(spark, d), ["amount"], keep_label=True)
    return _rounded(done.drop(allocation.TRACE), "amount")


# ---- mapping


def _rule(code: str, priority: float, conditions: dict[str, str], outputs: dict[str, str | None], order: float = 1, keep: str | None = "是") -> dict:
    row: dict = {"order_execution": order, "priority": priority, "mapping_code": code, "keep_row": keep}
    for i, (k, v) in enumerate(conditions.items(), 1):
        row |= {f"source_field_{i}": k, f"source_code_{i}": v}
    for i, (k, v) in enumerate(outputs.items(), 1):
        row |= {f"output_field_{i}": k, f"output_code_{i}": v}
    return row


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _mapped(spark: SparkSession, d: str, rules: list[dict], *outputs: str) -> DataFrame:
    return mapping.mapping_1t(_parts(spark, d), rules).select("p_partkey", *outputs)


@_register("SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'one' ELSE 'two' END AS cls, CASE p_brand WHEN 'Brand#1' THEN 'r1' ELSE 'r2' END AS map_trc_cls FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
def map_exact(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, [_rule("r1", 1, {"p_brand": "Brand#1"}, {"cls": "one"}), _rule("r2", 1, {"p_brand": "Brand#2"}, {"cls": "two"})], "cls", "map_trc_cls")


@_register("SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'ON$') AND p_size = 5 THEN 'both' WHEN regexp_matches(p_type, '^ECON') THEN 'econ' END AS cls FROM part WHERE regexp_matches(p_type, '^ECON') OR regexp_matches(p_type, 'ON$') AND p_size = 5")
def map_regex(spark: SparkSession, d: str) -> DataFrame:
    rules = [_rule("r1", 1, {"p_type": "reg{^ECON}"}, {"cls": "econ"}), _rule("r2", 2, {"p_type": "reg{ON$}", "p_size": "5"}, {"cls": "both"})]
    return _mapped(spark, d, rules, "cls")


_LAYERED = [_rule("r1", 1, {}, {"cls": "other", "tier": "base"}), _rule("r2", 2, {"p_brand": "Brand#1"}, {"cls": "one", "tier": None}), _rule("r3", 3, {"p_brand": "Brand#1", "p_type": "reg{^ECON}"}, {"cls": None, "tier": "econ"}), _rule("r4", 3, {"p_brand": "Brand#2", "p_type": "PROMO"}, {"cls": "two", "tier": "promo"})]


@_register("""WITH h AS (SELECT p_partkey, p_brand = 'Brand#1' AS a, p_brand = 'Brand#1' AND regexp_matches(p_type, '^ECON') AS b, p_brand = 'Brand#2' AND p_type = 'PROMO' AS c FROM part)
SELECT p_partkey, CASE WHEN c THEN 'two' WHEN a THEN 'one' ELSE 'other' END AS cls, CASE WHEN c THEN 'promo' WHEN b THEN 'econ' ELSE 'base' END AS tier,
  'r1' || CASE WHEN a THEN '->r2' ELSE '' END || CASE WHEN b THEN '->r3' ELSE '' END || CASE WHEN c THEN '->r4' ELSE '' END AS map_trc_tier FROM h""")
def map_layered(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, _LAYERED, "cls", "tier", "map_trc_tier")


@_register("SELECT p_partkey, 'all' AS cls, '是' AS keep_row FROM part")
def map_catch_all(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, [_rule("r1", 1, {}, {"cls": "all"}), _rule("r9", 1, {}, {"cls": "never"})], "cls", "keep_row")


@_register(r"SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN p_type ELSE regexp_extract(p_brand, '#(\d+)', 1) END AS cls, p_size AS size FROM part")
def map_variable(spark: SparkSession, d: str) -> DataFrame:
    rules = [_rule("r1", 1, {}, {"cls": r"var{p_brand}->reg{#(\d+)}", "size": "var{p_size}"}), _rule("r2", 2, {"p_brand": "Brand#1"}, {"cls": "var{p_type}", "size": None})]
    return _mapped(spark, d, rules, "cls", "size")


@_register("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END || '/' || p_brand[1:3] AS txt, CAST(p_size * 2 + length(p_type) AS DOUBLE) / 4 AS num, CAST(((p_size - 7) % 5 + 5) % 5 AS BIGINT) AS rest FROM part""")
def map_expression(spark: SparkSession, d: str) -> DataFrame:
    rule = _rule("r1", 1, {}, {"txt": "exp{('big' if p_size > 25 else 'small') + '/' + p_brand[:3]}", "num": "exp{(p_size * 2 + len(p_type)) / 4}", "rest": "exp{(p_size - 7) % 5}"})
    return _mapped(spark, d, [rule], "txt", "num", "rest")


_BATCHES = [_rule("a1", 1, {"p_brand": "reg{#[12]}"}, {"cls": "low"}, 1), _rule("a2", 2, {"p_brand": "Brand#12"}, {"cls": "drop"}, 1, "否"), _rule("b1", 1, {"cls": "low", "p_size": "reg{^[1-4]}"}, {"p_type": "var{p_name}", "cls": None}, 2)]


@_register("SELECT p_partkey, p_name AS p_type, CAST(NULL AS VARCHAR) AS cls FROM part WHERE regexp_matches(p_brand, '#[12]') AND p_brand <> 'Brand#12' AND regexp_matches(CAST(p_size AS VARCHAR), '^[1-4]')")
def map_batches(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, _BATCHES, "p_type", "cls")


@_register("""SELECT p_partkey, 1.0::DOUBLE AS miss_order_execution FROM part WHERE NOT regexp_matches(p_brand, '#[12]')
UNION ALL SELECT p_partkey, 2.0 FROM part WHERE regexp_matches(p_brand, '#[12]') AND p_brand <> 'Brand#12' AND NOT regexp_matches(CAST(p_size AS VARCHAR), '^[1-4]')""")
def map_missed(spark: SparkSession, d: str) -> DataFrame:
    return mapping.map_table(_parts(spark, d), _BATCHES).missed.select("p_partkey", "miss_order_execution")


_TABLE_RULES = """WITH r AS (SELECT * FROM mapping_1t WHERE order_execution = 10 AND nullif(source_code_1, '') IS NOT NULL AND nullif(source_code_2, '') IS NULL AND source_field_1 = 'entity' AND NOT starts_with(source_code_1, 'reg{')),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source_code_1 ORDER BY rule_id) = 1),
best AS (SELECT source_code_1 AS entity, string_agg(mapping_code, '->' ORDER BY priority, rule_id) AS trace FROM u GROUP BY 1)
"""


@_register(_TABLE_RULES + " SELECT detail_id, trace AS map_trc_report_line FROM detail JOIN best USING (entity)")
def map_table_rules(spark: SparkSession, d: str) -> DataFrame:
    """The equality rules of ``mapping_1t`` on ``entity``, applied to all of ``detail``."""
    rules = query(ship(spark), f"""SELECT * FROM (SELECT rule_id, order_execution, 1 AS priority, mapping_code, '是' AS keep_row, source_field_1, source_code_1, 'report_line' AS output_field_1, 'x' AS output_code_1,
      row_number() OVER (PARTITION BY source_code_1 ORDER BY rule_id) AS n FROM read_parquet('{d}/mapping_1t.parquet')
      WHERE order_execution = 10 AND nullif(source_code_1, '') IS NOT NULL AND nullif(source_code_2, '') IS NULL AND source_field_1 = 'entity' AND source_code_1 NOT LIKE 'reg{{%') WHERE n = 1""").drop("n", "rule_id")
    return mapping.mapping_1t(table(spark, d, "detail").select("detail_id", "entity"), rules).select("detail_id", "map_trc_report_line")


#: What an empty condition is compared as: the reference matches an empty value with an empty one.
_NOTHING = "∅"


def _layer_rules(spark: SparkSession, d: str) -> DataFrame:
    """All rules of ``mapping_1t``, made valid: an empty condition holds where the value is empty too, and rules of one
    priority go by ``rule_id``, each with a priority of its own, whatever their conditions."""
    return query(ship(spark), f"""SELECT order_execution, row_number() OVER (PARTITION BY order_execution ORDER BY priority, rule_id) AS priority, mapping_code, keep_row,
      '__' || source_field_1 AS source_field_1, CASE WHEN source_field_1 IS NOT NULL THEN coalesce(nullif(source_code_1, ''), '{_NOTHING}') END AS source_code_1,
      '__' || source_field_2 AS source_field_2, CASE WHEN source_field_2 IS NOT NULL THEN coalesce(nullif(source_code_2, ''), '{_NOTHING}') END AS source_code_2, output_field_1, output_code_1
      FROM read_parquet('{d}/mapping_1t.parquet') ORDER BY rule_id""")


_MEETS = "CASE WHEN starts_with({s}, 'reg{{') THEN regexp_matches(CASE WHEN {v} = '' THEN '∅' ELSE {v} END, substr({s}, 5, length({s}) - 5)) ELSE {v} = {s} END"
_LAYERS = f"""WITH d AS (SELECT detail_id, entity, coalesce(entity, '') AS e, coalesce(element_code, '') AS c, CASE WHEN length(period) >= 4 THEN period ELSE rpad(coalesce(period, ''), 4, '-') END AS period FROM detail),
r AS (SELECT order_execution AS o, mapping_code, nullif(keep_row, '') AS keep, nullif(output_code_1, '') AS out, coalesce(source_code_1, '') AS s1, coalesce(source_code_2, '') AS s2, source_field_2 IS NULL AS one, row_number() OVER (PARTITION BY order_execution ORDER BY priority, rule_id) AS n FROM mapping_1t),
h AS (SELECT e, c, o, string_agg(mapping_code, '->' ORDER BY n) AS trace, arg_max(keep, n) AS keep, arg_max(out, n) AS out
  FROM (SELECT DISTINCT e, c FROM d) JOIN r ON {_MEETS.format(s='s1', v='e')} AND (one OR {_MEETS.format(s='s2', v='c')}) GROUP BY e, c, o),
w AS (SELECT e, c, max(trace) FILTER (WHERE o = 10) AS t1, max(trace) FILTER (WHERE o = 20) AS t2, max(trace) FILTER (WHERE o = 30) AS t3, max(keep) FILTER (WHERE o = 10) AS k1, max(keep) FILTER (WHERE o = 20) AS k2, max(keep) FILTER (WHERE o = 30) AS k3,
  max(out) FILTER (WHERE o = 10) AS o1, max(out) FILTER (WHERE o = 20) AS o2, max(out) FILTER (WHERE o = 30) AS o3 FROM h GROUP BY e, c),
x AS (SELECT d.*, w.* EXCLUDE (e, c), CASE WHEN t1 IS NULL THEN 1 WHEN k1 = '是' AND t2 IS NULL THEN 2 WHEN k1 = '是' AND k2 = '是' AND t3 IS NULL THEN 3 WHEN k1 = '是' AND k2 = '是' AND k3 = '是' THEN 4 END AS state FROM d LEFT JOIN w ON w.e = d.e AND w.c = d.c),
y AS (SELECT *, CASE state WHEN 2 THEN o1 WHEN 3 THEN o2 WHEN 4 THEN o3 END AS out, CASE state WHEN 2 THEN t1 WHEN 3 THEN t2 WHEN 4 THEN t3 END AS trace FROM x WHERE state IS NOT NULL)
SELECT detail_id, CASE WHEN out = 'var{{entity}}' THEN entity WHEN starts_with(out, 'var{{period}}') THEN substr(period, 1, 4) ELSE out END AS report_line, trace AS map_trc_report_line, CASE WHEN state < 4 THEN CAST(state * 10 AS DOUBLE) END AS miss_order_execution FROM y"""


@_register(_LAYERS)
def map_table_layers(spark: SparkSession, d: str) -> DataFrame:
    """``mapping_1t`` as a whole on ``detail``: all orders, conditions, priorities, outputs and keep flags.

    Rows no rule of an order hits come with that order as ``miss_order_execution`` and what earlier orders gave them;
    rows that are not to be kept don't come. Periods shorter than four characters are filled up with '-', so that
    ``var{period}->reg{^(....)}`` finds something.
    """
    rows = table(spark, d, "detail").select(
        "detail_id", "entity", F.when(F.length("period") >= 4, F.col("period")).otherwise(F.rpad(F.coalesce("period", F.lit("")), 4, "-")).alias("period"),
        *[F.when(F.coalesce(c, F.lit("")) == "", _NOTHING).otherwise(F.col(c)).alias(f"__{c}") for c in ("entity", "element_code")],
    )
    done = mapping.map_table(rows, _layer_rules(spark, d))
    kept = done.result.withColumn("miss_order_execution", F.lit(None).cast("double"))
    return unify.union_relaxed([kept, done.missed]).select("detail_id", "report_line", "map_trc_report_line", "miss_order_execution")


# ---- SQL


def _sql(name: str, spark_sql: str, duck: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return query(ship(spark), re.sub(r"@(\w+)", rf"read_parquet('{d}/\1.parquet')", spark_sql))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = duck


def _same(name: str, sql: str) -> None:
    _sql(name, sql, sql.replace("@", ""))


_same("sql_join_agg", "SELECT n_name, CAST(count(*) AS BIGINT) AS n_orders, round(sum(o_totalprice), 4) AS total FROM @orders JOIN @customer ON o_custkey = c_custkey JOIN @nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name HAVING count(*) > 1")
_same("sql_window_rank", "SELECT c_custkey, c_nationkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS place, coalesce(lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey), 0) AS above FROM @customer")
_same("sql_rollup", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS quantity FROM @lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_same("sql_set_ops", "SELECT s_nationkey AS k FROM @supplier INTERSECT SELECT c_nationkey FROM @customer EXCEPT SELECT n_nationkey FROM @nation WHERE n_regionkey = 0")
_same("sql_top_k", "SELECT o_orderkey, o_totalprice FROM @orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_same("sql_cte_anti", "WITH big AS (SELECT o_custkey FROM @orders WHERE o_totalprice > 100000) SELECT c_custkey, c_mktsegment FROM @customer WHERE NOT EXISTS (SELECT 1 FROM big WHERE o_custkey = c_custkey)")


# ---- chained steps


@_register(f"""WITH {_FACTS}, clean AS (SELECT nation, flag AS status, amount FROM facts WHERE flag IN ('R', 'A')), b AS (SELECT * FROM {_values(_BASIC, _F_NAMES)}), {_SHARE},
done AS (SELECT nation, in_segment AS segment, amount * share AS amount FROM clean JOIN s ON nation = out_nation UNION ALL SELECT nation, NULL, 0.0 - amount FROM clean WHERE nation IN (SELECT out_nation FROM s))
SELECT nation, segment, round(sum(amount), 3) AS amount FROM done GROUP BY 1, 2""")
def pipeline_month_close(spark: SparkSession, d: str) -> DataFrame:
    """Standardise, filter, allocate and group: four steps in one plan."""
    facts = tab.standardize(_facts(spark, d), [{"standard": "nation", "src": "nation", "dtype": "string"}, {"standard": "status", "src": "flag", "dtype": None}, {"standard": "amount", "src": "amount", "dtype": "float"}], "src")
    kept = tab.filter_rows(facts, {"status": {"in": ["R", "A"]}})
    done = allocation.allocate_basic(kept, _factors(spark, _BASIC), ["out_nation"], ["in_segment"], ["amount"], names=_NATIONS, label=False)
    return tab.group_sum(done, ["amount"], ["nation", "segment"]).withColumn("amount", F.round("amount", 3))
