"""Queries of the general operators for training data (problems 1, 3, 4, 5, 6), with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.operators import drift, hierarchy, orphans, profile, twocopy
from ruleframe.session import table
from ruleframe.storage import cut

LEDGER_KEY = ["voucher_no", "line_no"]
LEDGER_FIELDS = ["entity", "element_code", "period", "currency", "amount", "memo", "posted_on", "state"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchy.build(table(spark, d, "metadata")).nodes
    return nodes.select("dimension", "element_code", "root_code", "depth", "link_state")


def p1_contracted(spark: SparkSession, d: str) -> DataFrame:
    """``p1_found`` with lists ranked in one task only up to 200 elements: several rounds of contraction at any size."""
    nodes = hierarchy.build(table(spark, d, "metadata"), rank_in_one_task=200).nodes
    return nodes.select("dimension", "element_code", "root_code", "depth", "link_state")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.build(table(spark, d, "metadata")).paths()


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.build(table(spark, d, "metadata")).closure().drop("is_leaf")


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame]]:
    members = table(spark, d, "metadata")
    return members, [
        orphans.references("metadata", members, "meta_id", "parent", "created_at", "dimension"),
        orphans.references("detail", table(spark, d, "detail"), "detail_id", "element_code", "booked_at", F.lit("account")),
        orphans.references("check_result", table(spark, d, "check_result"), "check_id", "CHECK_ELEMENT_CODE", "checked_at", "CHECK_DIMENSION"),
    ]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find(*_references(spark, d)).rows


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find(*_references(spark, d)).counts


def _ledgers(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "df_diff")
    sides = [both.where(F.col("_tmp_diff_src") == s) for s in ("df_1", "df_2")]
    return twocopy.by_field(twocopy.compare(*sides, LEDGER_KEY, LEDGER_FIELDS, {"amount": 0.005}), LEDGER_KEY)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _ledgers(spark, d).select(*LEDGER_KEY, "change", "field_name")


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """Both values of each differing field, amounts and dates too; records of one side only with nulls."""
    return _ledgers(spark, d)


def _books(spark: SparkSession, d: str) -> DataFrame:
    """The records of all schedule books and of all sheets; a series is told by its table and its name."""
    steps = table(spark, d, "schedule").select(F.struct(F.lit("schedule").alias("t"), F.concat_ws("|", "book_code", "function").alias("s")).alias("series"), "file_no", F.col("step_order").cast("double").alias("rec"), F.col("params").alias("json"), "loaded_at")
    sheets = table(spark, d, "sheet_rows").select(F.struct(F.lit("sheet_rows").alias("t"), F.col("input_sheet_name").alias("s")).alias("series"), "file_no", F.col("row_key").cast("double").alias("rec"), F.col("record").alias("json"), "loaded_at")
    named = steps.unionByName(sheets).where("series.s is not null")
    return drift.parse(named, "series", "file_no", "rec", "json", "loaded_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = drift.changes(_books(spark, d))
    return found.select(F.col("series.t").alias("table_name"), F.col("series.s").alias("series"), F.col("file").alias("file_no"), F.col("field").alias("field_name"), "change", "new_field")


def _unified(spark: SparkSession, d: str) -> DataFrame:
    records = cut(_books(spark, d))
    return drift.unify(records, cut(drift.changes(records)))


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every record under its field's last name; records without fields as one row of nulls."""
    one = drift.cells(_unified(spark, d))
    return one.select(F.col("series.t").alias("table_name"), F.col("series.s").alias("series"), F.col("file").alias("file_no"), F.col("rec").alias("record_key"), F.col("field").alias("field_name"), "kind", "value")


def p4_schedule_table(spark: SparkSession, d: str) -> DataFrame:
    """All files of all schedule books as one typed table."""
    one = drift.as_columns(cut(_unified(spark, d).where("series.t = 'schedule'")))
    return one.withColumns({"series": F.col("series.s"), "rec": F.col("rec")}).withColumnsRenamed({"file": "file_no", "rec": "step_order"})


def p4_sheet_table(spark: SparkSession, d: str) -> DataFrame:
    """All files of all sheets as one typed table."""
    one = drift.as_columns(cut(_unified(spark, d).where("series.t = 'sheet_rows'")))
    return one.withColumns({"series": F.col("series.s"), "rec": F.col("rec").cast("int")}).withColumnsRenamed({"series": "input_sheet_name", "file": "file_no", "rec": "row_key"})


#: The declared forms: mined masks are accepted only as far as their values keep them.
DECLARED = {"period": "[0-9]{4}(0[1-9]|1[0-2])", "is_base": "Y|N"}
PERIODS = {"period": ("202401", "202512")}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    detail, members = table(spark, d, "detail"), table(spark, d, "metadata")
    flags = {"is_base": DECLARED["is_base"]}
    counts = cut(profile.mask_counts(detail, "load_id", declared=DECLARED))
    mined = profile.mine(counts.where(F.col("column_name").isin(*DECLARED)))
    single = profile.violations(detail, "detail_id", mined, DECLARED, PERIODS, "load_id").withColumn("table_name", F.lit("detail"))
    mined = profile.mine(cut(profile.mask_counts(members, None, ["is_base"], flags)))
    odd = profile.violations(members, "meta_id", mined, flags).withColumn("table_name", F.lit("metadata"))
    before = cut(profile.previous_loads(table(spark, d, "load_log")))
    medians = {"amount": cut(profile.group_medians(detail, "load_id", "amount"))}
    loads = profile.load_departures(counts, medians, before, {"is_base": "Y"})
    loads = loads.withColumns({"table_name": F.lit("detail"), "row_id": F.lit(0).cast("long"), "load_id": F.col("load_id").cast("int")})
    names = ["table_name", "finding", "column_name", "load_id", "row_id"]
    return single.select(*names).unionByName(odd.select(*names)).unionByName(loads.select(*names))


def _two_tables(spark: SparkSession, d: str) -> list[tuple[str, str, str | None, DataFrame]]:
    """(name, row id, group, rows) of the tables that are profiled."""
    return [("detail", "detail_id", "load_id", table(spark, d, "detail")), ("metadata", "meta_id", None, table(spark, d, "metadata"))]


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Each column of ``detail`` by load (``scope`` ``load``), and of ``detail`` and ``metadata`` as a whole (``scope`` ``table``, ``load_id`` null)."""
    parts = []
    for name, _, group, rows in _two_tables(spark, d):
        if group:
            parts.append(profile.profile(rows, group=group).withColumnRenamed("grp", "load_id").withColumns({"table_name": F.lit(name), "scope": F.lit("load")}))
        parts.append(profile.profile(rows).withColumns({"table_name": F.lit(name), "scope": F.lit("table"), "load_id": F.lit(None).cast("int")}))
    return reduce(DataFrame.unionByName, parts).withColumn("dominant_masks", F.array_join("dominant_masks", " | "))


def p5_rare_masks(spark: SparkSession, d: str) -> DataFrame:
    """The masks of both tables that are not dominant in their column, at the step at which the column is judged."""
    parts = []
    for name, _, group, rows in _two_tables(spark, d):
        counts = cut(profile.mask_counts(rows, group))
        parts.append(profile.rare_masks(counts, profile.mine(counts)).select(F.lit(name).alias("table_name"), "column_name", "level", "mask", "n"))
    return reduce(DataFrame.unionByName, parts)


def p5_rare_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows that hold those masks, one row a value."""
    parts = []
    for name, row_id, group, rows in _two_tables(spark, d):
        mined = profile.mine(cut(profile.mask_counts(rows, group)))
        parts.append(profile.violations(rows, row_id, mined, group=group).select(F.lit(name).alias("table_name"), "column_name", "load_id", "row_id", "mask"))
    return reduce(DataFrame.unionByName, parts)


def p5_divergence(spark: SparkSession, d: str) -> DataFrame:
    counts = cut(profile.mask_counts(table(spark, d, "detail"), "load_id"))
    found = profile.divergence(counts, cut(profile.previous_loads(table(spark, d, "load_log"))))
    return found.withColumn("divergence", F.round("divergence", 6) + 0.0)


QUERIES = {f.__name__: f for f in (p1_found, p1_contracted, p1_paths, p1_descendants, p3_found, p3_counts, p4_found, p4_unified, p4_schedule_table, p4_sheet_table, p5_found, p5_profile, p5_rare_masks, p5_rare_rows, p5_divergence, p6_found, p6_values)}

TREE = """WITH RECURSIVE m AS (
  SELECT dimension AS d, element_code AS c, min(CASE WHEN trim(parent) <> '' THEN parent END) AS p FROM metadata
  WHERE dimension IS NOT NULL AND element_code IS NOT NULL GROUP BY 1, 2),
r AS (
  SELECT d, c, c AS root, c AS path, 0 AS depth FROM m WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM m x WHERE x.d = m.d AND x.c = m.p)
  UNION ALL SELECT m.d, m.c, r.root, r.path || '/' || m.c, r.depth + 1 FROM m JOIN r ON m.d = r.d AND m.p = r.c)"""

_ORPHANS = """WITH refs AS (
  SELECT 'metadata' AS table_name, meta_id AS row_id, dimension AS d, parent AS c, created_at AS t FROM metadata
  UNION ALL SELECT 'detail', detail_id, 'account', element_code, booked_at FROM detail
  UNION ALL SELECT 'check_result', check_id, CHECK_DIMENSION, CHECK_ELEMENT_CODE, checked_at FROM check_result),
judged AS (
  SELECT table_name, row_id, strftime(t, '%Y%m') AS ref_month, count(element_code) AS n,
    count(*) FILTER (WHERE created_at <= t AND (deleted_at IS NULL OR deleted_at > t)) AS valid, count(*) FILTER (WHERE created_at <= t) AS begun
  FROM refs LEFT JOIN metadata ON dimension = d AND element_code = c WHERE trim(c) <> '' GROUP BY table_name, row_id, t),
bad AS (SELECT table_name, row_id, CASE WHEN n = 0 THEN 'missing' WHEN begun = 0 THEN 'late' ELSE 'deleted' END AS reason, ref_month FROM judged WHERE valid = 0)"""

_DIFF = """WITH l AS (SELECT DISTINCT * EXCLUDE (copy_id, _tmp_diff_src) FROM df_diff WHERE _tmp_diff_src = 'df_1'),
r AS (SELECT DISTINCT * EXCLUDE (copy_id, _tmp_diff_src) FROM df_diff WHERE _tmp_diff_src = 'df_2'),
j AS (SELECT coalesce(l.voucher_no, r.voucher_no) AS voucher_no, coalesce(l.line_no, r.line_no) AS line_no, l.voucher_no IS NULL AS no_l, r.voucher_no IS NULL AS no_r, l, r
  FROM l FULL JOIN r ON l.voucher_no = r.voucher_no AND l.line_no = r.line_no)"""
_TEXTS = ["entity", "element_code", "period", "currency", "memo", "state"]
_DIFF_TEXTS = " UNION ALL ".join(
    f"SELECT voucher_no, line_no, 'changed' AS change, '{f}' AS field_name, l.{f} AS left_value, r.{f} AS right_value FROM j WHERE NOT no_l AND NOT no_r AND coalesce(l.{f}, '') <> coalesce(r.{f}, '')"
    for f in _TEXTS
)

_P4 = """WITH src AS (
  SELECT 'schedule' AS t, book_code || '|' || function AS s, file_no AS f, CAST(step_order AS DOUBLE) AS r, params AS j FROM schedule
  UNION ALL SELECT 'sheet_rows', input_sheet_name, file_no, row_key, record FROM sheet_rows),
one AS (SELECT t, s, f, r, any_value(j) AS j FROM src GROUP BY ALL),
cells AS (SELECT t, s, f, r, e.key AS k, CASE WHEN e.type <> 'NULL' THEN CAST(e.value AS VARCHAR) END AS v,
  CASE e.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM one, json_each(j) e),
tr AS (SELECT t, s, f, lag(f) OVER (PARTITION BY t, s ORDER BY f) AS p FROM (SELECT DISTINCT t, s, f FROM one)),
flds AS (SELECT t, s, f, k, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM cells GROUP BY ALL),
starts AS (SELECT tr.*, a.k FROM tr JOIN flds a ON a.t = tr.t AND a.s = tr.s AND a.f = tr.f ANTI JOIN flds b ON b.t = tr.t AND b.s = tr.s AND b.f = tr.p AND b.k = a.k WHERE p IS NOT NULL),
stops AS (SELECT tr.*, a.k FROM tr JOIN flds a ON a.t = tr.t AND a.s = tr.s AND a.f = tr.p ANTI JOIN flds b ON b.t = tr.t AND b.s = tr.s AND b.f = tr.f AND b.k = a.k),
pairs AS (SELECT o.t, o.s, o.f, o.p, o.k AS old, n.k AS new FROM stops o JOIN starts n ON n.t = o.t AND n.s = o.s AND n.f = o.f),
ren AS (SELECT q.t, q.s, q.f, q.old, q.new FROM pairs q JOIN one a ON a.t = q.t AND a.s = q.s AND a.f = q.p JOIN one b ON b.t = q.t AND b.s = q.s AND b.f = q.f AND b.r = a.r
  LEFT JOIN cells x ON x.t = q.t AND x.s = q.s AND x.f = q.p AND x.r = a.r AND x.k = q.old LEFT JOIN cells y ON y.t = q.t AND y.s = q.s AND y.f = q.f AND y.r = a.r AND y.k = q.new
  GROUP BY ALL HAVING bool_and(x.v IS NOT DISTINCT FROM y.v)),
found AS (SELECT t, s, f, old AS k, 'renamed' AS change, new FROM ren
  UNION ALL SELECT t, s, f, k, 'removed', '' FROM stops WHERE (t, s, f, k) NOT IN (SELECT t, s, f, old FROM ren)
  UNION ALL SELECT t, s, f, k, 'added', '' FROM starts WHERE (t, s, f, k) NOT IN (SELECT t, s, f, new FROM ren)
  UNION ALL SELECT tr.t, tr.s, tr.f, a.k, 'retyped', '' FROM tr JOIN flds a ON a.t = tr.t AND a.s = tr.s AND a.f = tr.f JOIN flds b ON b.t = tr.t AND b.s = tr.s AND b.f = tr.p AND b.k = a.k WHERE a.kinds <> b.kinds)
SELECT t AS table_name, s AS series, f AS file_no, k AS field_name, change, new AS new_field FROM found"""

_P5_COLUMNS = ["detail_id", "voucher_no", "line_no", "period", "entity", "element_code", "is_base", "currency", "amount", "amount2", "booked_at"]
_P5 = (
    """WITH s AS (SELECT load_id, count(*) AS n, """
    + ", ".join(f"count({c}) AS c_{c}" for c in _P5_COLUMNS)
    + """, count(*) FILTER (WHERE is_base = 'Y') AS y, median(abs(amount)) AS med FROM detail GROUP BY load_id),
b AS (SELECT load_id, lag(load_id) OVER (PARTITION BY feed_code ORDER BY load_seq) AS prev FROM load_log),
j AS (SELECT s AS a, o AS o FROM b JOIN s ON s.load_id = b.load_id JOIN s o ON o.load_id = b.prev)
SELECT 'detail' AS table_name, 'pattern' AS finding, 'period' AS column_name, load_id, detail_id AS row_id FROM detail WHERE NOT regexp_full_match(period, '[0-9]{4}(0[1-9]|1[0-2])')
UNION ALL SELECT 'detail', 'pattern', 'is_base', load_id, detail_id FROM detail WHERE is_base NOT IN ('Y', 'N')
UNION ALL SELECT 'metadata', 'pattern', 'is_base', 0, meta_id FROM metadata WHERE is_base NOT IN ('Y', 'N')
UNION ALL SELECT 'detail', 'range', 'period', load_id, detail_id FROM detail WHERE regexp_full_match(period, '[0-9]{4}(0[1-9]|1[0-2])') AND (period < '202401' OR period > '202512')
UNION ALL SELECT 'detail', 'mix', 'is_base', a.load_id, 0 FROM j WHERE round(abs(a.y / a.c_is_base - o.y / o.c_is_base), 9) >= 0.2
UNION ALL SELECT 'detail', 'median', 'amount', a.load_id, 0 FROM j WHERE a.med >= o.med * 10 OR a.med <= o.med / 10"""
    + "".join(f" UNION ALL SELECT 'detail', 'null_share', '{c}', a.load_id, 0 FROM j WHERE round(abs(a.c_{c} / a.n - o.c_{c} / o.n), 9) >= 0.1" for c in _P5_COLUMNS)
)

_CLASSED = "regexp_replace(v, '[0-9]', chr(1), 'g')"
for _pattern, _sign in ((r"\p{Lu}", "A"), (r"\p{Ll}", "a"), (r"[\p{Lo}\p{Lm}\p{Lt}\p{M}]", "w"), (r"\p{Nd}", "d"), (r"\x01", "9"), (r"[\p{Cf}\x{80}-\x{9f}]", "?")):
    _CLASSED = f"regexp_replace({_CLASSED}, '{_pattern}', '{_sign}', 'g')"
_TEXT_COLUMNS = ["voucher_no", "period", "entity", "element_code", "is_base", "currency"]
_META_COLUMNS = ["dimension", "element_code", "element_name", "is_base", "parent"]
_SHORT = "m"
for _sign in ("A", "a", "9", "w", "d", "\\?"):
    _SHORT = f"regexp_replace({_SHORT}, '{_sign}+', '{_sign[-1]}', 'g')"
_CELLS = " UNION ALL ".join(
    [f"SELECT 'detail' AS t, load_id, detail_id AS row_id, '{c}' AS c, {c} AS v, TRUE AS txt FROM detail" for c in _TEXT_COLUMNS]
    + [f"SELECT 'detail', load_id, detail_id, '{c}', CASE WHEN {c} IS NOT NULL THEN 'value' END, FALSE FROM detail" for c in _P5_COLUMNS if c not in _TEXT_COLUMNS]
    + ["SELECT 'detail', load_id, detail_id, 'load_id', CASE WHEN load_id IS NOT NULL THEN 'value' END, FALSE FROM detail"]
    + [f"SELECT 'metadata', NULL, meta_id, '{c}', {c}, TRUE FROM metadata" for c in _META_COLUMNS]
    + [f"SELECT 'metadata', NULL, meta_id, '{c}', CASE WHEN {c} IS NOT NULL THEN 'value' END, FALSE FROM metadata" for c in ("meta_id", "created_at", "deleted_at")]
)
_MASKS = f"""WITH v AS ({_CELLS}),
x AS (SELECT t, load_id, row_id, c, v, CASE WHEN txt THEN {_CLASSED} ELSE v END AS m FROM v),
m AS (SELECT t, load_id, row_id, c, v, unnest([{{'k': 0, 'name': 'tail', 'm': substr(m, 1, greatest(length(m) - 2, 0)) || right(v, 2)}}, {{'k': 1, 'name': 'class', 'm': m}}, {{'k': 2, 'name': 'runs', 'm': CASE WHEN m = 'value' AND v = 'value' THEN m ELSE {_SHORT} END}}], recursive := true) FROM x),
n AS (SELECT t, c, k, name, m, count(*) AS n, sum(count(*)) OVER (PARTITION BY t, c, k) AS whole FROM m WHERE m IS NOT NULL GROUP BY t, c, k, name, m),
top AS (SELECT * FROM n WHERE n / whole >= 0.02),
lev AS (SELECT t, c, min(k) AS k FROM (SELECT t, c, k FROM top GROUP BY t, c, k, whole HAVING sum(n) >= 0.9 * whole) GROUP BY t, c)"""
_DISTINCT_MASKS = _MASKS + """, u AS (SELECT m.t, m.load_id, m.c, m.m, count(*) AS n, top.m IS NOT NULL AND lev.k IS NOT NULL AS dominant, lev.k IS NULL AS unruly
  FROM m LEFT JOIN lev ON lev.t = m.t AND lev.c = m.c LEFT JOIN top ON top.t = m.t AND top.c = m.c AND top.k = m.k AND top.m = m.m WHERE m.k = coalesce(lev.k, 2) AND m.m IS NOT NULL GROUP BY ALL)"""


def _profiled(name: str, columns: list[str], texts: list[str], scope: str) -> str:
    """The profile of one table, by load or as a whole."""
    g = "load_id" if scope == "load" else "NULL::INTEGER"
    def shown(c: str, f: str) -> str:
        if c in ("amount", "amount2"):
            return f"CAST(CAST({f}({c}) AS DECIMAL(38, 6)) AS VARCHAR)"
        return f"strftime({f}({c}), '%Y-%m-%d %H:%M:%S.%f')" if c.endswith("_at") else f"CAST({f}({c}) AS VARCHAR)"
    stats = " UNION ALL ".join(f"SELECT {g} AS load_id, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct, {shown(c, 'min')} AS least, {shown(c, 'max')} AS greatest FROM {name} GROUP BY {g}" for c in columns)
    masks = f"SELECT {g} AS load_id, c, m, any_value(dominant) AS dominant, any_value(unruly) AS unruly, sum(n) AS n FROM u WHERE t = '{name}' GROUP BY ALL"
    folded = f"SELECT load_id, c, count(*) AS n_masks, string_agg(m, ' | ' ORDER BY m) FILTER (WHERE dominant) AS dominant_masks, sum(CASE WHEN dominant OR unruly THEN 0 ELSE n END) AS rare_rows FROM ({masks}) GROUP BY load_id, c"
    return f"""SELECT '{name}' AS table_name, '{scope}' AS scope, s.load_id, s.column_name, n_rows, n_nulls, n_nulls / n_rows AS null_rate, n_distinct, least, greatest,
  coalesce((SELECT ['tail', 'class', 'runs'][k + 1] FROM lev WHERE t = '{name}' AND lev.c = s.column_name), 'none') AS level,
  coalesce(n_masks, 0) AS n_masks, dominant_masks, CAST(coalesce(rare_rows, 0) AS BIGINT) AS rare_rows
FROM ({stats}) s LEFT JOIN ({folded}) k ON k.c = s.column_name AND k.load_id IS NOT DISTINCT FROM s.load_id"""


ORACLE = {
    "p1_found": TREE
    + """, below AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.d = m.d AND r.c = m.c)),
walk AS (SELECT d, c, p AS at FROM below UNION SELECT w.d, w.c, b.p FROM walk w JOIN below b ON b.d = w.d AND b.c = w.at)
SELECT d AS dimension, c AS element_code, root AS root_code, depth, 'tree' AS link_state FROM r
UNION ALL SELECT d, c, '', -1, CASE WHEN EXISTS (SELECT 1 FROM walk w WHERE w.d = below.d AND w.c = below.c AND w.at = below.c) THEN 'on_cycle' ELSE 'below_cycle' END FROM below""",
    "p1_paths": TREE
    + """ SELECT a.d AS dimension, a.c AS element_code, a.path, a.depth, a.root AS root_code,
  (SELECT count(*) FROM r b WHERE b.d = a.d AND starts_with(b.path, a.path || '/')) AS n_descendants FROM r a""",
    "p1_descendants": TREE
    + """ SELECT b.d AS dimension, a.c AS ancestor, b.c AS descendant, b.depth - a.depth AS distance
FROM r b JOIN r a ON a.d = b.d AND a.root = b.root AND (b.path = a.path OR starts_with(b.path, a.path || '/'))""",
    "p3_found": _ORPHANS + " SELECT table_name, row_id, reason, ref_month FROM bad",
    "p3_counts": _ORPHANS + " SELECT table_name, ref_month, reason, count(*) AS n_orphans FROM bad GROUP BY ALL",
    "p4_found": _P4,
    "p4_unified": _P4.replace("WITH src", "WITH RECURSIVE src").partition("SELECT t AS table_name")[0] + """,
walk AS (SELECT DISTINCT t, s, f, k, k AS cur, f AS upto FROM cells
  UNION ALL SELECT w.t, w.s, w.f, w.k, r.new, r.f FROM walk w JOIN ren r ON r.t = w.t AND r.s = w.s AND r.old = w.cur AND r.f > w.upto
  WHERE r.f = (SELECT min(x.f) FROM ren x WHERE x.t = w.t AND x.s = w.s AND x.old = w.cur AND x.f > w.upto)),
final AS (SELECT t, s, f, k, arg_max(cur, upto) AS cur FROM walk GROUP BY t, s, f, k)
SELECT t AS table_name, s AS series, f AS file_no, r AS record_key, cur AS field_name, kind, v AS value
FROM (SELECT t, s, f, r, e.key AS k, CASE WHEN e.type <> 'NULL' THEN e.value ->> '$' END AS v,
  CASE e.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM one, json_each(j) e) JOIN final USING (t, s, f, k)""",
    "p5_found": _P5,
    "p5_rare_masks": _MASKS + " SELECT n.t AS table_name, n.c AS column_name, name AS level, m AS mask, n FROM n JOIN lev ON lev.t = n.t AND lev.c = n.c AND lev.k = n.k WHERE n / whole < 0.02",
    "p5_rare_rows": _MASKS + """ SELECT m.t AS table_name, m.c AS column_name, coalesce(load_id, 0) AS load_id, row_id, m.m AS mask FROM m JOIN lev ON lev.t = m.t AND lev.c = m.c AND lev.k = m.k
  JOIN n ON n.t = m.t AND n.c = m.c AND n.k = m.k AND n.m = m.m WHERE n / whole < 0.02""",
    "p5_profile": _DISTINCT_MASKS + " " + " UNION ALL ".join([
        _profiled("detail", _P5_COLUMNS, _TEXT_COLUMNS, "load"), _profiled("detail", [*_P5_COLUMNS, "load_id"], _TEXT_COLUMNS, "table"), _profiled("metadata", ["meta_id", *_META_COLUMNS, "created_at", "deleted_at"], _META_COLUMNS, "table"),
    ]),
    "p5_divergence": f"""WITH v AS ({_CELLS}), x AS (SELECT load_id, c, v, CASE WHEN txt THEN {_CLASSED} ELSE v END AS m FROM v WHERE t = 'detail' AND c <> 'load_id'),
counts AS (SELECT load_id, c AS column_name, substr(m, 1, greatest(length(m) - 2, 0)) || right(v, 2) AS mask, count(*) AS n FROM x GROUP BY ALL)""" + """, p AS (SELECT load_id, column_name, coalesce(mask, chr(0)) AS mask, n / sum(n) OVER (PARTITION BY load_id, column_name) AS p FROM counts),
b AS (SELECT load_id, lag(load_id) OVER (PARTITION BY feed_code ORDER BY load_seq) AS prev FROM load_log),
k AS (SELECT b.load_id, b.prev, column_name FROM b JOIN (SELECT DISTINCT load_id, column_name FROM p) x ON x.load_id = b.load_id WHERE prev IN (SELECT load_id FROM p)),
u AS (SELECT k.load_id, k.column_name, mask, p, 0.0 AS q FROM k JOIN p ON p.load_id = k.load_id AND p.column_name = k.column_name
  UNION ALL SELECT k.load_id, k.column_name, mask, 0.0, p FROM k JOIN p ON p.load_id = k.prev AND p.column_name = k.column_name),
s AS (SELECT load_id, column_name, mask, sum(p) AS p, sum(q) AS q FROM u GROUP BY ALL)
SELECT load_id, column_name, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0.0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0.0 END) + 0.0, 6) AS divergence FROM s GROUP BY ALL""",
    "p6_found": _DIFF
    + f""" SELECT voucher_no, line_no, CASE WHEN no_r THEN 'only_df_1' ELSE 'only_df_2' END AS change, '' AS field_name FROM j WHERE no_l OR no_r
UNION ALL SELECT voucher_no, line_no, 'changed', 'amount' FROM j WHERE NOT no_l AND NOT no_r AND (l.amount IS NULL) <> (r.amount IS NULL)
UNION ALL SELECT voucher_no, line_no, 'changed', 'amount' FROM j WHERE NOT no_l AND NOT no_r AND abs(l.amount - r.amount) >= 0.005
UNION ALL SELECT voucher_no, line_no, 'changed', 'posted_on' FROM j WHERE NOT no_l AND NOT no_r AND l.posted_on IS DISTINCT FROM r.posted_on
UNION ALL SELECT voucher_no, line_no, change, field_name FROM ({_DIFF_TEXTS})""",
    "p6_values": _DIFF
    + f""" SELECT voucher_no, line_no, CASE WHEN no_r THEN 'only_df_1' ELSE 'only_df_2' END AS change, '' AS field_name, NULL AS left_value, NULL AS right_value FROM j WHERE no_l OR no_r
UNION ALL SELECT voucher_no, line_no, 'changed', 'amount', CAST(CAST(l.amount AS DECIMAL(38, 6)) AS VARCHAR), CAST(CAST(r.amount AS DECIMAL(38, 6)) AS VARCHAR) FROM j
  WHERE NOT no_l AND NOT no_r AND ((l.amount IS NULL) <> (r.amount IS NULL) OR abs(l.amount - r.amount) >= 0.005)
UNION ALL SELECT voucher_no, line_no, 'changed', 'posted_on', CAST(l.posted_on AS VARCHAR), CAST(r.posted_on AS VARCHAR) FROM j WHERE NOT no_l AND NOT no_r AND l.posted_on IS DISTINCT FROM r.posted_on
UNION ALL SELECT * FROM ({_DIFF_TEXTS})""",
}
ORACLE["p1_contracted"] = ORACLE["p1_found"]
