import pytest

from ruleframe.errors import RuleError
from ruleframe.operators import table, unify


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, "ab", 1.5, True), (2, "", None, False), (3, None, 2.5, None)], "k int, `t.x` string, v double, b boolean")


def keys(df, conditions):
    return sorted(r.k for r in table.filter_rows(df, conditions).collect())


@pytest.mark.parametrize(
    ("conditions", "want"),
    [
        ({}, [1, 2, 3]), ({"k": 1}, [1]), ({"k": {"ne": 1}}, [2, 3]), ({"k": {"gt": 1, "le": 2}}, [2]), ({"v": None}, [2]), ({"v": {"ne": None}}, [1, 3]), ({"t.x": {"ne": "ab"}}, [2]),
        ({"k": {"in": [1, None]}}, [1]), ({"k": {"not_in": [1, None]}}, [2, 3]), ({"v": {"not_in": []}}, [1, 3]), ({"k": {"in": []}}, []), ({"t.x": {"contains": "b"}}, [1]), ({"k": {"starts_with": "2"}}, [2]),
        ({"t.x": {"ends_with": ""}}, [1, 2]), ({"v": {"is_null": True}}, [2]), ({"v": {"is_null": False}}, [1, 3]), ({"v": {"is_not_null": False}}, [2]), ({"k": [1, 2]}, []), ('{"k": {"ge": 2}, "b": false}', [2]), ({"t.x": {"contains": "."}}, []),
    ],
)
def test_operators(df, conditions, want):
    assert keys(df, conditions) == want


@pytest.mark.parametrize("conditions", [{"no": 1}, {"k": {}}, {"k": {"like": 1}}, {"k": "1"}, {"t.x": 1}, {"k": {"in": 1}}, {"t.x": {"contains": 1}}, {"v": {"is_null": "y"}}, "[1]", "{", {"b": 1}])
def test_errors(df, conditions):
    with pytest.raises(RuleError):
        table.filter_rows(df, conditions)


def test_drop_empty(spark, rows):
    df = spark.createDataFrame([(1, "", 1.0), (2, "hello", 1.0), (None, "world", 1.0), (4, " \t", float("nan")), (5, "x", float("inf"))], "A int, B string, C double")
    assert rows(table.drop_empty(df, ["A", "B"]).select("A")) == [(2,), (5,)]
    assert rows(table.drop_empty(df, ["B", "C"], "all").select("B")) == [("",), ("hello",), ("world",), ("x",)]
    with pytest.raises(RuleError):
        table.drop_empty(df, mode="some")


def test_projections(spark, rows):
    df = spark.createDataFrame([("a1", "b1", " 12.5 ")], "a string, b string, d string")
    out = table.standardize(df, [{"standard": "A", "s": "a"}, {"standard": "B", "s": "b"}, {"standard": "C", "s": None}, {"standard": "D", "s": "d", "dtype": "float"}], "s")
    assert out.columns == ["A", "B", "C", "D"] and rows(out) == [("a1", "b1", None, 12.5)]
    with pytest.raises(Exception, match="no number"):
        table.standardize(df, [{"standard": "D", "s": "a", "dtype": "float"}], "s").collect()
    with pytest.raises(RuleError):
        table.standardize(df, [{"standard": "D", "s": "a"}, {"standard": "D", "s": "b"}], "s")
    assert table.rename_over(df, {"a": "b", "x": "y"}).columns == ["b", "d"]
    assert rows(table.unpivot(df, ["a", "b"], "n", "v").select("n", "v")) == [("a", "a1"), ("b", "b1")]
    assert table.drop_null_columns(table.assign(df, {"e": None})).columns == ["a", "b", "d"]
    for bad in ({}, {" ": 1}, {1: 1}):
        with pytest.raises(RuleError):
            table.assign(df, bad)


def test_amounts_and_sums(spark, rows):
    df = spark.createDataFrame([("a", None, "x"), ("a", " ", "y"), ("b", "12.5", "x"), (None, "1", "x")], "g string, v string, o string")
    assert rows(table.group_sum(df, ["v"], ["g"])) == [("a", 0.0), ("b", 12.5), (None, 1.0)]
    assert rows(table.group_sum(df, ["v"], exclude=["o"])) == rows(table.group_sum(df, ["v"], ["g"]))
    assert rows(table.group_sum(df, None, ["g"])) == [("a",), ("b",), (None,)]
    with pytest.raises(RuleError):
        table.group_sum(df, ["v"], ["g"], ["o"])
    for bad in ("abc", "1d", "NaN"):
        with pytest.raises(Exception, match="no finite number"):
            table.group_sum(spark.createDataFrame([("a", bad)], "g string, v string"), ["v"], ["g"]).collect()
    result, verify = table.group_sum_checked(df, ["v"], ["g"])
    result.collect()
    verify()


def test_unions(spark, rows):
    a, b = spark.createDataFrame([(1, "x")], "k int, s string"), spark.createDataFrame([(2.5, True)], "k double, s boolean")
    assert rows(unify.concat([a, b], "src", ["one", "two"])) == [(1.0, "x", "one"), (2.5, "true", "two")]
    with pytest.raises(RuleError):
        unify.concat([a], "src", ["x", "y"])
    base = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, s string")
    up = spark.createDataFrame([(9, "x")], "k int, s string")
    want = [(2, "y"), (3, None), (9, "x")]
    once = unify.replace_partition(base, up, {"s": "x"})
    assert rows(once) == want and rows(unify.replace_partition(once, up, {"s": "x"})) == want
    for bad in ({"s": "y"}, {}):
        with pytest.raises(RuleError):
            unify.replace_partition(base, up, bad)
    with pytest.raises(RuleError):
        unify.replace_partition(base, up.limit(0), {"s": "x"})
