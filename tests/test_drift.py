import itertools
import json
import random

from ruleframe.operators import drift

S = "s string, f int, r int, j string, at int, kinds string"


def changes(spark, data):
    records = drift.parse(spark.createDataFrame(data, S), "s", "f", "r", "j", "at")
    return sorted(tuple(x) for x in drift.changes(records).collect())


def row(f, r, o, s="a", at=0):
    return (s, f, r, o if o is None or isinstance(o, str) else json.dumps(o), at, "x")


def test_each_change(spark):
    data = [
        row(1, 1, {"a": "x", "b": 1, "c": None, "d": [1]}), row(1, 2, {"a": "y", "b": 2, "d": [2]}),
        row(3, 1, {"A": "x", "b": "1", "e": True, "d": [1]}, at=1), row(3, 2, {"A": "y", "b": "2", "d": [2]}, at=2), row(3, 2, {"A": "y", "b": "2", "d": [2]}, at=1),
    ]
    assert changes(spark, data) == [("a", 3, "a", "renamed", "A"), ("a", 3, "b", "retyped", ""), ("a", 3, "c", "removed", ""), ("a", 3, "e", "added", "")]


def test_ties_go_by_name(spark):
    data = [row(1, r, {"net_amount": 5, "tax_code": 5}) for r in (1, 2)] + [row(2, r, {"taxCode": 5, "NetAmount": 5}) for r in (1, 2)]
    assert changes(spark, data) == [("a", 2, "net_amount", "renamed", "NetAmount"), ("a", 2, "tax_code", "renamed", "taxCode")]


def test_nulls_and_broken_text(spark):
    data = [row(1, 1, None), row(1, 2, "no json"), row(1, 3, {"a": 1}), row(None, 3, {"a": 1}), row(2, None, {"a": 2}), row(2, 3, "[1]"), (None, 1, 1, "{}", 0, "x")]
    assert changes(spark, data) == []
    assert changes(spark, []) == []


def test_unify_follows_renames(spark):
    data = [row(1, 1, {"a": 1, "k": "v"}), row(2, 1, {"b": 1, "k": "v"}), row(3, 1, {"c": 1, "k": "v"}), row(3, 2, {"c": 2})]
    records = drift.parse(spark.createDataFrame(data, S), "s", "f", "r", "j", "at")
    found = {(x.file, x.rec): x.fields for x in drift.unify(records, drift.changes(records)).collect()}
    assert found[1, 1] == {"c": "1", "k": '"v"'} and found[2, 1] == {"c": "1", "k": '"v"'} and found[3, 2] == {"c": "2"}


def test_assignment_is_optimal():
    r = random.Random(5)
    for n, m in ((1, 1), (2, 3), (3, 2), (4, 4), (5, 3)):
        gain = [[r.random() for _ in range(m)] for _ in range(n)]
        got = sum(gain[i][j] for i, j in drift.assign(gain))
        if n <= m:
            best = max(sum(gain[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = max(sum(gain[p[j]][j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert abs(got - best) < 1e-9
    assert drift.assign([]) == []


def test_series_of_two_parts(spark):
    data = [("t", "a", 1, r, json.dumps({"net_amount": 5, "tax_code": 5})) for r in (1, 2)] + [("t", "a", 2, r, json.dumps({"taxCode": 5, "NetAmount": 5})) for r in (1, 2)]
    rows = spark.createDataFrame(data, "t string, s string, f int, r int, j string").selectExpr("struct(t, s) as series", "f", "r", "j")
    records = drift.parse(rows, "series", "f", "r", "j")
    found = drift.changes(records)
    assert sorted((tuple(x.series), x.field, x.new_field) for x in found.collect()) == [(("t", "a"), "net_amount", "NetAmount"), (("t", "a"), "tax_code", "taxCode")]
    assert {tuple(sorted(x.fields)) for x in drift.unify(records, found).collect()} == {("NetAmount", "taxCode")}


def test_two_fields_under_one_name(spark):
    data = [row(1, 1, {"a": 1, "b": 2}), row(2, 1, {"b": 1}), row(3, 1, {"b": 1})]
    records = drift.parse(spark.createDataFrame(data, S), "s", "f", "r", "j", "at")
    renames = spark.createDataFrame([("a", 2, "a", "renamed", "b")], "series string, file int, field string, change string, new_field string")
    found = {x.file: x.fields for x in drift.unify(records, renames).collect()}
    assert found[1] in ({"b": "1"}, {"b": "2"}) and found[2] == {"b": "1"}


def test_records_without_key_are_kept(spark):
    data = [row(1, None, {"a": 1}, at=1), row(1, None, {"b": 2}, at=2), row(1, None, {"b": 2}, at=2), row(1, 1, {"c": 3}), row(2, None, {"b": 2}, at=3), row(2, None, {"a": 1}, at=4), row(2, 1, {"c": 3})]
    assert changes(spark, data) == []
    records = drift.parse(spark.createDataFrame(data, S), "s", "f", "r", "j", "at")
    found = sorted((x.file, x.rec or 0, *x.fields.items()) for x in drift.unify(records, drift.changes(records)).collect())
    assert found == [(1, 0, ("a", "1")), (1, 0, ("b", "2")), (1, 0, ("b", "2")), (1, 1, ("c", "3")), (2, 0, ("a", "1")), (2, 0, ("b", "2")), (2, 1, ("c", "3"))]


def test_one_typed_table(spark):
    data = [
        row(1, 1, {"Rate": 1.5, "ok": True, "tag ": ["x"], "n": 1}), row(1, 2, {"Rate": 2, "ok": None, "n": "one"}), row(2, 1, {"rate_v2": 1.5, "ok": True, "tag ": ["x"], "n": 1}), row(2, 2, {"rate_v2": 2, "n": "one"}),
        row(1, 1, {"RATE": 7, "rate1": 8, "tag": {"a": 1}}, s="b"), row(1, 2, {}, s="b"), row(1, 3, None, s="b"),
    ]
    records = drift.parse(spark.createDataFrame(data, S), "s", "f", "r", "j", "at")
    one = drift.as_columns(drift.unify(records, drift.changes(records)))
    assert dict(one.dtypes) == {"series": "string", "file": "int", "rec": "int", "n": "string", "ok": "boolean", "RATE": "double", "rate_2": "double", "rate1": "double", "tag": "string"}
    found = {(x.series, x.file, x.rec): x.asDict() for x in one.collect()}
    assert len(found) == 7 and found["a", 1, 1]["rate_2"] == 1.5 and found["a", 2, 2]["rate_2"] == 2.0 and found["a", 2, 2]["n"] == "one" and found["a", 1, 1]["n"] == "1"
    assert found["b", 1, 1]["RATE"] == 7.0 and found["b", 1, 1]["rate1"] == 8.0 and found["b", 1, 1]["tag"] == '{"a":1}' and found["a", 1, 1]["tag"] == '["x"]'
    assert drift.as_columns(drift.unify(records, drift.changes(records)).limit(0)).count() == 0


def test_hot_series_and_salts(spark, monkeypatch):
    """One series with most of the records is cut by record; the changes stay."""
    monkeypatch.setattr(drift, "heavy_keys", lambda counted, keys, n, share: counted.where("n > 50").select(*keys))
    data = [row(f, k, {("a" if f < 3 else "A"): k, "b": str(k) if f < 2 else k, "c": None}) for f in (1, 2, 3) for k in range(200)] + [row(1, 1, {"x": 1}, s="z"), row(2, 1, {"y": 1}, s="z"), row(2, None, {"y": 2}, s="z"), row(3, None, {"c": 2})]
    assert changes(spark, data) == [("a", 2, "b", "retyped", ""), ("a", 3, "a", "renamed", "A"), ("z", 2, "x", "renamed", "y")]


def test_wide_ties_are_matched_by_name():
    r = random.Random(8)
    names = [f"field_{chr(97 + k % 26)}{chr(97 + k // 26)}_amount" for k in range(120)]
    stops, starts = [(n, 1, 0, 0) for n in names], [(n.upper(), 1, 0, 0) for n in names]
    r.shuffle(starts)
    assert all(starts[j][0] == stops[i][0].upper() for i, j in drift.match(stops, starts).items())
    assert len(drift.match(stops, starts[:50])) == 50 and drift.match([], starts) == {}


def test_plain_names_either_way(spark):
    names = ["Net Amount", "netAmount", "net-amount_v2", "rate1", " rate ", "成本中心", "Übertrag", "v2", "", "__x__"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(drift._plain_column(df["n"])).collect()] == [drift._plain(n) for n in names]
