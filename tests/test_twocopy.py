from ruleframe.operators import twocopy
from ruleframe.queries import core

S = "k string, n int, amount double, memo string, l string, r string"


def test_fields_nulls_and_repeats(spark, rows):
    a = spark.createDataFrame([("x", 1, 1.0, None, "p", "q"), ("x", 1, 1.0, None, "p", "q"), ("y", 1, 2.0, "m", None, None), (None, 1, 5.0, "t", "", ""), ("only", 1, 1.0, "", "", "")], S)
    b = spark.createDataFrame([("x", 1, 1.004, "", "p", "q"), ("y", 1, 2.006, "M", "", "z"), (None, 1, None, "t", None, ""), ("new", None, 1.0, "", "", "")], S)
    found = twocopy.by_field(twocopy.compare(a, b, ["k", "n"], tolerance={"amount": 0.005}), ["k", "n"])
    assert rows(found.select("k", "n", "change", "field_name")) == sorted(
        [("y", 1, "changed", "amount"), ("y", 1, "changed", "memo"), ("y", 1, "changed", "r"), (None, 1, "changed", "amount"), ("only", 1, "only_df_1", ""), ("new", None, "only_df_2", "")], key=repr
    )


def test_equal_and_empty(spark):
    a = spark.createDataFrame([("x", 1, float("nan"), None, "p", "q")], S)
    assert twocopy.compare(a, a, ["k", "n"], tolerance={"amount": 1.0}).count() == 0
    assert twocopy.compare(a.limit(0), a.limit(0), ["k", "n"]).count() == 0
    assert twocopy.compare(a, a.limit(0), ["k", "n"]).first()["change"] == "only_df_1"


def test_values_of_every_field(spark):
    sides = {"df_1": {}, "df_2": {}}
    for r in spark.read.parquet("/root/testdata/sf0.001/df_diff.parquet").distinct().collect():
        sides[r._tmp_diff_src][r.voucher_no, r.line_no] = r
    far = lambda f, x, y: (x is None) != (y is None) or (x is not None and abs(x - y) >= 0.005) if f == "amount" else x != y if f == "posted_on" else (x or "") != (y or "")
    text = lambda f, v: None if v is None else f"{v:.6f}" if f == "amount" else str(v)
    want = {(*k, f, text(f, a[f]), text(f, b[f])) for k, a in sides["df_1"].items() if (b := sides["df_2"].get(k)) for f in core.LEDGER_FIELDS if far(f, a[f], b[f])}
    found = core.p6_values(spark, "/root/testdata/sf0.001").where("change = 'changed'").collect()
    assert {(r.voucher_no, r.line_no, r.field_name, r.left_value, r.right_value) for r in found} == want and len(found) == len(want)
    assert {"amount", "posted_on"} <= {r.field_name for r in found}


def test_layout_differences(spark, rows):
    a = spark.createDataFrame([(1, "x", 2)], "k int, v string, w int")
    b = spark.createDataFrame([(1, 5, 2)], "k int, v int, u int")
    assert rows(twocopy.layout(a, b)) == [("u", None, "int"), ("v", "string", "int"), ("w", "int", None)]
    assert twocopy.layout(a, a).count() == 0
