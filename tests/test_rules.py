import re
from datetime import date

import pytest

from ruleframe.errors import RuleError
from ruleframe.operators import diff, joins, quality
from ruleframe.plans import allocation, mapping
from ruleframe.plans.expressions import compile_expression
from ruleframe.queries import steps
from ruleframe.queries.steps import _rule


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("n // 2", -4), ("n % 3", 2), ("n / 2", -3.5), ("-n", 7), ("round(h)", 2), ("round(1.235, 1)", 1.2), ("int(2.9)", 2), ("t[:2] + t[-1]", "heo"), ("t[1]", "e"), ("len(t)", 5), ("1 < 2 < 3", True), ("'a' if n > 0 else 'b'", "b"),
        ("max(n, 3, 1)", 3), ("sum([1, 2, n])", -4), ("abs(n)", 7), ("z or 5", 5), ("n and 3", 3), ("not z", True), ("str(3) * 2", "33"), ("'ell' in t", True), ("n in [1, -7]", True), ("e", "0"), ("float('1.5') + 1", 2.5), ("t == 1", False), ("2 ** 3", 8.0),
        ("arrow.get(p, 'YYYYMM').shift(months=-1, days=2).format('YYYY-MM-DD')", "2023-12-03"), ("arrow.get(d).shift(quarters=1).month", 6), ("arrow.get(d) < arrow.get('2024-04-01')", True),
    ],
)
def test_expressions(spark, text, want):
    df = spark.createDataFrame([(-7, 2.5, "hello", None, " ", "202401", date(2024, 3, 31))], "n int, h double, t string, z int, e string, p string, d date")
    assert df.select(compile_expression(df, text)[0].alias("x")).first().x == want


@pytest.mark.parametrize("text", ["open('x')", "t.upper()", "n + t", "[x for x in t]", "nan", "lambda: 1", "q", "1 +", "t[::2]", "().__class__", "arrow.utcnow()", "t.format('x')", "arrow.get(t).shift(parsecs=1)"])
def test_refused_expressions(spark, text):
    df = spark.createDataFrame([(1, "x")], "n int, t string")
    with pytest.raises(RuleError):
        compile_expression(df, text)


def test_layers_and_misses(spark, rows):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, None, 6), (3, None, 6)], "k int, f string, g int")
    rules = [_rule("r1", 1, {"f": "a"}, {"x": "X", "y": None}), _rule("r2", 2, {"g": "5"}, {"x": None, "y": "var{f}"})]
    done = mapping.map_table(df, rules)
    assert rows(done.result.select("k", "x", "y", "map_trc_x")) == [(1, "X", "a", "r1->r2"), (2, None, "b", "r2")]
    assert rows(done.missed.select("k", "miss_order_execution")) == [(3, 1.0), (3, 1.0)]
    with pytest.raises(RuleError):
        mapping.mapping_1t(df, rules, miss_ok=False)
    assert mapping.map_table(df.limit(0), rules).result.count() == 0


def test_rule_table_faults(spark):
    good = _rule("r1", 1, {"f": "a"}, {"x": "X"})
    faults = [
        [good, good], [good | {"priority": "1"}], [good | {"mapping_code": None}], [good | {"source_field_1": None}], [good | {"source_code_1": ""}], [good, _rule("r2", 1, {"g": "a"}, {"x": "X"})],
        [good, _rule("r2", 1, {"f": "a"}, {"x": "Y"})], [good, _rule("r2", 2, {"f": "b"}, {"y": "Y"})], [_rule("r1", 1, {"f": "a"}, {"x": "exp{nan}"})],
    ]
    for rules in faults:
        with pytest.raises(RuleError):
            mapping.read_rules(rules)
    df = spark.createDataFrame([("abc",)], "f string")
    with pytest.raises(Exception, match="finds nothing"):
        mapping.mapping_1t(df, [_rule("r", 1, {}, {"x": r"var{f}->reg{(\d)}"})]).collect()
    assert mapping.mapping_1t(df, [_rule("r", 1, {"f": "reg{b"}, {"x": "1"})]).count() == 0


def factors(spark, *data):
    return spark.createDataFrame(data, "out_d string, in_t string, rate double")


def test_allocation_weights(spark, rows):
    facts = spark.createDataFrame([("A", 100.0), ("B", -50.0), ("C", 7.0)], "d string, v double")
    table = factors(spark, ("A", "x", 1.0), ("A", "y", 3.0), ("B", "x", 2.0), ("B", "y", 2.0), ("Z", "x", None))
    done = allocation.allocate(facts, table, None, ["v"], keep_label=True)
    assert rows(done.select("d", "t", "v", "dim_alclabel")) == sorted([("A", None, -100.0, "out"), ("A", "x", 25.0, "in"), ("A", "y", 75.0, "in"), ("B", None, 50.0, "out"), ("B", "x", -25.0, "in"), ("B", "y", -25.0, "in")], key=repr)
    watched, verify = allocation.conserved(done, ["v"])
    watched.collect()
    verify()
    for bad in (factors(spark, ("A", "x", 0.0)), factors(spark, ("A", "x", 1.0), ("A", "y", -1.0)), factors(spark, ("A", "x", None))):
        with pytest.raises(Exception, match="no usable weight"):
            allocation.allocate(facts, bad, None, ["v"]).collect()
    assert allocation.allocate(facts.limit(0), table, None, ["v"]).count() == 0


def test_family_rounds(spark, rows):
    facts = spark.createDataFrame([("A", "A1", 1.0), ("A", None, 2.0), ("B", "B1", 4.0), ("", "A1", 8.0)], "d string, e string, v double")
    one = spark.createDataFrame([("A", "A1", "x", 1.0)], "d string, e string, t string, rate double")
    two = spark.createDataFrame([("A", "y", 1.0), ("", "y", 1.0)], "d string, t string, rate double")
    done, missing = allocation.allocate_family(facts, [(["d", "e"], ["t"], one), (["d"], ["t"], two)], ["v"])
    assert rows(done.where("t is not null").select("t", "v")) == [("x", 1.0), ("y", 2.0)]
    assert rows(missing.select("v")) == [(4.0,), (8.0,)]


def test_expansion_faults(spark, rows, monkeypatch):
    schema = "dimension string, element_code string, is_base string, parent string"
    tree = [("d", "top", "N", None), ("d", "mid", "N", "top"), ("d", "b1", "Y", "mid"), ("d", "b2", "Y", "top"), ("d", "under", "Y", "b1")]
    meta = spark.createDataFrame(tree, schema)
    want = [("d", "mid", "b1"), ("d", "top", "b1"), ("d", "top", "b2")]
    assert rows(allocation.base_members(meta)) == want
    for bad in (tree + [tree[0]], [("d", "a", "N", "b"), ("d", "b", "N", "a")]):
        with pytest.raises(RuleError):
            allocation.base_members(spark.createDataFrame(bad, schema)).collect()
    out = allocation.expand_factors(factors(spark, ("top", "x", 1.0), ("reg{mi}", "x", 2.0), ("odd", "x", 3.0), (None, "x", 4.0)), meta)
    assert rows(out.select("out_d", "rate")) == sorted([("b1", 1.0), ("b2", 1.0), ("b1", 2.0), ("odd", 3.0), (None, 4.0)], key=repr)
    monkeypatch.setattr(allocation, "MEMBERS_ON_DRIVER", 1)
    assert rows(allocation.base_members(meta)) == want


def test_joins(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (None, "n")], "k int, v string")
    right = spark.createDataFrame([(1, "X"), (2, "Y"), (3, "Z")], "k int, v string")
    merged = lambda p: rows(joins.merge_left(left, right, ["k"], if_duplicate=p))
    assert merged("keep_right_if_left_isnull") == [(1, "a"), (2, "Y"), (3, "Z"), (None, "n")]
    assert merged("keep_left")[0] == (1, "a") and merged("keep_right")[0] == (1, "X")
    assert joins.merge_left(left, right, ["k"], right_suffix="_r").columns == ["k", "v", "v_r"]
    with pytest.raises(RuleError):
        merged("raise")
    with pytest.raises(RuleError):
        joins.merge_left(left, right.unionByName(right), ["k"], if_duplicate="keep_left")
    ok, wide = joins.assemble_by_pid([left.withColumnRenamed("k", "pid"), spark.createDataFrame([(1, 5)], "pid int, w int")])
    assert ok and wide.count() == 4
    assert not joins.assemble_by_pid([spark.createDataFrame([(1, 5), (1, 6)], "pid int, w int")])[0]
    assert joins.assemble_by_pid([]) == (True, None)


def test_diffs(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "X"), (3, ""), (4, "n")], "k int, v string")
    found = diff.diff_rows(a, b)
    assert rows(found) == [("1", "X", "df_2"), ("1", "x", "df_1"), ("4", "n", "df_2")]
    assert diff.diff_rows(a.distinct(), a.distinct()).count() == 0
    side = {r["k"]: (r["差异类型"], r["变更字段"]) for r in diff.report(found, ["k"]).collect()}
    assert side == {"1": ("改", ["v"]), "4": ("增", [])}
    groups = diff.diff_groups(a, ["v"], ["k"], b)
    assert rows(groups.select("v", "k_diff")) == sorted([("x", 1.0), ("y", 4.0), ("None", 3.0), ("X", -1.0), ("", -3.0), ("n", -4.0)], key=repr)


def test_member_checks(spark, rows):
    meta = spark.createDataFrame([("d", "top", "t", "N", None), ("d", "b", "b", "Y", "top"), ("e", "z", "z", "Y", None)], "dimension string, element_code string, element_name string, is_base string, parent string")
    assert quality.check_metadata(meta).count() == 0
    data = spark.createDataFrame([(1, "b"), (2, "top"), (3, " "), (4, "reg{x}"), (5, None)], "k int, d string")
    found = quality.check_members(data, meta)
    assert rows(found.select("k", "CHECK_DIMENSION", "REASON")) == sorted([(2, "d", "not a base member"), (3, "d", "value is blank"), (5, "d", "value is blank"), (None, "e", "the data have no such column")], key=repr)


def test_whole_rule_table(spark):
    """``map_table_layers`` against the rules applied row by row."""
    d = "/root/testdata/sf0.001"
    rules = {}
    for r in sorted(spark.read.parquet(f"{d}/mapping_1t.parquet").collect(), key=lambda r: (r.order_execution, r.priority, r.rule_id)):
        rules.setdefault(r.order_execution, []).append(r)
    fits = lambda code, v: re.search(code[4:-1], v or "") is not None if (code or "").startswith("reg{") else (code or "") == (v or "")
    assert len(rules) > 1 and {True, False} == {r.source_field_2 is None for r in rules[10]} and any((r.source_code_2 or "").startswith("reg{") for r in rules[10])
    want = []
    for row in spark.read.parquet(f"{d}/detail.parquet").collect():
        line, trace, missed = None, None, None
        for order, some in rules.items():
            hits = [r for r in some if fits(r.source_code_1, row.entity) and (r.source_field_2 is None or fits(r.source_code_2, row.element_code))]
            if not hits:
                missed = float(order)
                break
            line = ([None, *[r.output_code_1 for r in hits if r.output_code_1]])[-1]
            line = row.entity if line == "var{entity}" else (row.period or "").ljust(4, "-")[:4] if line and line.startswith("var{period}") else line
            trace = "->".join(r.mapping_code for r in hits)
            if hits[-1].keep_row != "是":
                break
        else:
            hits = [True]
        if missed is not None or hits == [True]:
            want.append((row.detail_id, line, trace, missed))
    found = sorted(tuple(r) for r in steps.map_table_layers(spark, d).collect())
    assert found == sorted(want) and any(r[1] for r in found)


def _rules(*given):
    """(code, conditions, outputs, order) each, with priorities in the order given."""
    out = []
    for n, (code, conditions, outputs, order) in enumerate(given):
        row = {"order_execution": order, "priority": n + 1, "mapping_code": code, "keep_row": "是"}
        for kind, pairs in (("source", conditions), ("output", outputs)):
            for k, (f, v) in enumerate(pairs.items(), 1):
                row |= {f"{kind}_field_{k}": f, f"{kind}_code_{k}": v}
        out.append(row)
    return out


@pytest.mark.parametrize("value", ["exp{k + 1} x", "exp{k", "x exp{k}", "var{k", "var{k}x", "var{k}->reg{a", "var{k}->xreg{a}"])
def test_malformed_values_are_errors(spark, value):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    with pytest.raises(RuleError):
        mapping.map_table(df, _rules(("r", {}, {"o": value}, 1)))


@pytest.mark.parametrize("by_row", [False, True])
def test_batches_are_linear(spark, tmp_path, by_row):
    """Eight batches, each a step on a column: one plan of few scans, and the same as step by step."""
    at = str(tmp_path / "t.parquet")
    spark.range(200).selectExpr("id", "cast(id % 7 as string) c", "id * 1.5 v").write.parquet(at)
    df = spark.read.parquet(at)
    given = [(f"a{n}{x}", {"c": str((x + n) % 7)}, {"c": str((x + n + 1) % 7)} | ({"w": "exp{v * 2}"} if by_row else {}), n) for n in range(8) for x in range(7 if n != 5 else 6)]
    # the seventh value is missed in batch 5
    done = mapping.map_table(df, [{**r, "priority": 1} for r in _rules(*given)])
    plan = done.result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") + plan.count("Scan parquet") <= 8 and "CartesianProduct" not in plan
    got = {r.id: (r.c, r.map_trc_c) for r in done.result.collect()}
    assert len(got) == 200 - len([k for k in range(200) if k % 7 == 6]) and all(c == str((k + 8) % 7) and trace == f"a7{k % 7}" for k, (c, trace) in got.items())
    assert {r.id for r in done.missed.collect()} == {k for k in range(200) if k % 7 == 6} and {(r.c, r.miss_order_execution, r.v) for r in done.missed.where("id = 6").collect()} == {("4", 5.0, 9.0)}


def test_rows_with_own_values_are_not_folded(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "k int, s string")
    done = mapping.map_table(df, _rules(("r", {"s": "a"}, {"o": "exp{__UUID__}"}, 1))).result
    assert done.select("o").distinct().count() == 3


def test_patterns_of_several_columns(spark, rows):
    df = spark.createDataFrame([(f"A{i % 5}", f"B{i % 3}", i % 2) for i in range(60)] + [(None, "B1", 1), ("", None, 0)], "a string, b string, c int")
    given = [("p", {"a": "reg{[12]}", "b": "reg{[01]}", "c": "1"}, {"o": "x"}, 1), ("q", {"a": "reg{^$}", "b": "reg{}"}, {"o": "y"}, 1), ("r", {"b": "reg{2"}, {"o": "never"}, 1)]
    done = mapping.map_table(df, _rules(*given)).result.select("a", "b", "c", "o").distinct()
    want = {(f"A{i % 5}", f"B{i % 3}", 1, "x") for i in range(60) if i % 5 in (1, 2) and i % 3 < 2 and i % 2} | {(None, "B1", 1, "y"), ("", None, 0, "y")}
    assert set(rows(done)) == want


def test_wide_rules(spark, rows):
    df = spark.createDataFrame([(1, "a", 3.0), (2, "b", None), (3, "c", 5.0), (4, None, 1.0)], "k int, s string, v double")
    wide = [
        {"映射规则类型": None, "映射优先顺序": 1, "映射规则编码": "all", "s": None, "k": None, "c": "exp{v * 2}", "d": "none"},
        {"映射规则类型": "s+k", "映射优先顺序": 2, "映射规则编码": "ab", "s": "reg{[ab]}", "k": "2", "c": None, "d": "exp{str(c + 1)}"},
    ]
    assert rows(mapping.map_n(df, wide, ["c", "d"]).select("k", "c", "d", "map_trc_c", "map_trc_d")) == [(1, 6.0, "none", "all", "all"), (2, 0.0, "1.0", "all->ab", "all->ab"), (3, 10.0, "none", "all", "all"), (4, 2.0, "none", "all", "all")]
    only = [{"rule_dimension": "s", "priority": 1, "mapping_code": "a", "s": "a", "c": "x"}]
    assert rows(mapping.map_n(df, only, ["c"]).select("k", "c", "map_trc_c")) == [(1, "x", "a"), (2, None, None), (3, None, None), (4, None, None)]
    assert mapping.map_n(df.withColumn("c", df["k"]), only, ["c"]).schema["c"].dataType.simpleString() == "string"
    for bad in ({"miss_ok": False}, {"outputs": ["v"], "drop_if_exists": False}):
        with pytest.raises(RuleError):
            mapping.map_n(df, [r | {"v": 1} for r in only], **({"outputs": ["c"]} | bad))
    with pytest.raises(RuleError):
        mapping.read_wide_rules([{"rule_dimension": "s+z", "priority": 1, "mapping_code": "a", "s": "a", "c": "x"}], ["c"])


def _recorded(monkeypatch):
    """The row counts of all that ``mapping`` writes."""
    counts = []

    def cut(df):
        counts.append((out := real(df)).count())
        return out

    real = mapping.cut
    monkeypatch.setattr(mapping, "cut", cut)
    return counts


def test_rows_no_rule_tells_apart_are_one(spark, monkeypatch):
    """Many values, few rules, outputs computed from the rows: written are kinds of rows, and the result is that row by row."""
    counts = _recorded(monkeypatch)
    data = [(i, ["E1", "E2", "E3", None, ""][i % 5], None if i % 211 == 0 else f"A{i * 37 % 1000:03d}", f"20{i % 90 + 10}") for i in range(3000)]
    df = spark.createDataFrame(data, "k int, e string, c string, p string")
    given = [
        ("a", {"c": "reg{^A}"}, {"o": "var{p}->reg{^(..)}"}, 1), ("b", {"e": "E1", "c": "reg{^A1}"}, {"o": None}, 1), ("c", {"e": "E1", "c": "A1"}, {"o": "never"}, 1), ("d", {"e": "E2", "c": "A005"}, {"o": "exact"}, 1),
        ("e", {"e": "E3", "c": "reg{}"}, {"o": "none"}, 1), ("f", {"c": "reg{^A12"}, {"o": "never"}, 1),
        ("g", {"e": "reg{^E}"}, {"o": "var{e}", "q": "var{c}"}, 2), ("h", {"e": "E2", "c": "reg{^A00}"}, {"o": "var{p}->reg{(.)$}", "q": "x"}, 2), ("i", {"c": "reg{^A9}"}, {"o": "nine", "q": "exp{k * 2}"}, 2),
    ]
    done = mapping.map_table(df, _rules(*given))
    kept, missed = [], []
    for k, e, c, p in data:
        first = [code for code, hit in (("a", (c or "").startswith("A")), ("b", e == "E1" and (c or "").startswith("A1")), ("d", (e, c) == ("E2", "A005")), ("e", e == "E3")) if hit]
        o = "none" if e == "E3" else "exact" if "d" in first else p[:2] if first else None
        second = [code for code, hit in (("g", (e or "").startswith("E")), ("h", e == "E2" and (c or "").startswith("A00")), ("i", (c or "").startswith("A9"))) if hit]
        if not first:
            missed.append((k, e, c, p, None, None, 1.0))
        elif not second:
            missed.append((k, e, c, p, o, "->".join(first), 2.0))
        else:
            line = {"g": e, "h": p[-1], "i": "nine"}[second[-1]]
            kept.append((k, e, c, p, line, {"g": c, "h": "x", "i": str(k * 2)}[second[-1]], "->".join(second)))
    by_key = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[0])
    assert by_key(done.result.select("k", "e", "c", "p", "o", "q", "map_trc_q")) == kept
    assert by_key(done.missed.select("k", "e", "c", "p", "o", "map_trc_o", "miss_order_execution")) == missed
    assert {r[6] for r in missed} == {1.0, 2.0} and max(counts) < 50


def test_values_of_replaced_batches_still_stop(spark):
    """A pattern that finds nothing is an error although a later batch replaces its value; not where no rule asks for it."""
    df = spark.createDataFrame([(1, "a", "x1"), (2, "b", "y")], "k int, s string, v string")
    given = lambda s: _rules(("r1", {"s": s}, {"o": r"var{v}->reg{(\d)}"}, 1), ("r2", {"s": s}, {"o": "var{v}"}, 2))
    with pytest.raises(Exception, match="finds nothing"):
        mapping.map_table(df, given("b")).result.collect()
    assert [tuple(r) for r in mapping.map_table(df, given("a")).result.select("k", "o").collect()] == [(1, "x1")]


def test_types_of_own_and_written_values(spark):
    """A column that only some rows got written, beside others' own values, and a condition on what a batch wrote."""
    df = spark.createDataFrame([(1, 5, 1.5), (2, 6, 2.5), (3, 7, None)], "k int, n int, v double")
    done = mapping.map_table(df, _rules(("r1", {"n": "5"}, {"n": "var{v}"}, 1), ("r2", {"n": "6"}, {"n": "var{v}"}, 1), ("r3", {"n": "1.5"}, {"x": "y"}, 2)))
    assert [(r.k, r.n, r.x) for r in done.result.collect()] == [(1, 1.5, "y")]
    assert {(r.k, r.n, r.map_trc_n, r.miss_order_execution) for r in done.missed.collect()} == {(2, 2.5, "r2", 2.0), (3, 7.0, None, 1.0)}
