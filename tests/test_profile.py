import random
from statistics import median

from pyspark.sql import functions as F

from ruleframe.operators import profile


def test_masks(spark):
    given = {
        "202405": ("999905", "999999", "9"), "Y": ("Y", "A", "A"), "Y ": ("Y ", "A ", "A "), "YES": ("AES", "AAA", "A"), "AC00-12-x": ("AA99-99-x", "AA99-99-a", "A9-9-a"), "２０２４０５": ("dddd０５", "dddddd", "d"),
        "Zürich": ("Aaaach", "Aaaaaa", "Aa"), "区a\u200bb": ("wa\u200bb", "wa?a", "wa?a"), "": ("", "", ""), "a" * 50: ("a" * 50, "a" * 50, "a"), "202401\n": ("999991\n", "999999\n", "9\n"),
    }
    df = spark.createDataFrame([(k,) for k in given] + [(None,)], "v string")
    found = {r.v: (r.tail, r["class"], r.runs) for r in df.select("v", *[profile.level_mask(df, "v", x).alias(x) for x in profile.LEVELS]).collect()}
    assert found == given | {None: (None, None, None)}


def test_medians_match(spark, monkeypatch):
    r = random.Random(2)
    data = []
    for g in range(6):
        data += [(g, r.choice([r.uniform(-1e5, 1e5), r.uniform(0, 1), round(r.gauss(50, 9), 2), 7.0, 0.0, 5e-324 * r.randrange(9), r.uniform(0, 1e308)])) for _ in range(r.randrange(1, 120))]
    data += [(1, None), (2, float("nan")), (None, 3.0), (9, None)]
    inf = float("inf")
    data += [(20, 1.0), (20, -inf), (20, inf), (21, 2.0), (21, inf)] + [(22, x / 100) for x in (12, 30, 30, 50, 99)]
    df = spark.createDataFrame(data, "g int, v double")
    want = {g: median(abs(v) for h, v in data if h == g and v is not None and v == v) for g in (*range(6), 20, 21, 22)}
    for parts in (4096, 8, 2):
        monkeypatch.setattr(profile, "PARTS", parts)
        got = {x.grp: x.median for x in profile.group_medians(df, "g", "v").collect()}
        assert got == want
    assert profile.group_medians(df.limit(0), "g", "v").count() == 0


def test_departures(spark, rows):
    data = [(1, None if i < 1 else "Y", 1.0) for i in range(10)] + [(2, None if i < 2 else "N", 10.0) for i in range(10)] + [(4, "N", 9.0)]
    df = spark.createDataFrame(data, "load_id int, is_base string, amount double")
    log = spark.createDataFrame([(1, "f", 1), (2, "f", 2), (3, "f", 3), (4, "f", 4)], "load_id int, feed_code string, load_seq int")
    counts = profile.mask_counts(df, "load_id")
    found = profile.load_departures(counts, {"amount": profile.group_medians(df, "load_id", "amount")}, profile.previous_loads(log), {"is_base": "Y"})
    assert rows(found) == [("median", "amount", 2), ("mix", "is_base", 2), ("null_share", "is_base", 2)]
    assert {(x.load_id, x.column_name): round(x.divergence, 3) for x in profile.divergence(counts, profile.previous_loads(log)).collect()}[2, "amount"] == 0.0


def test_violations(spark, rows):
    data = [(k, f"2024{k % 12 + 1:02d}", 1) for k in range(240)] + [(900, "202413", 1), (901, None, 1), (902, "202301", None), (903, "202401\n", 2)]
    df = spark.createDataFrame(data, "row_id long, period string, grp int")
    form = {"period": "[0-9]{4}(0[1-9]|1[0-2])"}
    mined = profile.mine(profile.mask_counts(df, None, ["period"], form))
    assert mined["period"].level == "tail" and mined["period"].masks == tuple(f"9999{m:02d}" for m in range(1, 13)) and mined["period"].broken == ()
    found = profile.violations(df, "row_id", mined, form, {"period": ("202401", "202512")}, "grp")
    assert rows(found.select("finding", "load_id", "row_id", "mask")) == [("pattern", 1, 900, "999913"), ("pattern", 2, 903, "999991\n"), ("range", 0, 902, "999901")]
    # without a declared form the mined masks alone decide
    assert rows(profile.violations(df, "row_id", mined).select("row_id")) == [(900,), (903,)]
    assert profile.violations(df.limit(0), "row_id", mined, form).count() == 0


def test_declared_forms_hold_against_common_faults(spark, rows):
    df = spark.createDataFrame([(k, "Y" if k % 2 else "y") for k in range(100)] + [(200, "Z")], "id long, flag string")
    mined = profile.mine(profile.mask_counts(df, None, ["flag"], {"flag": "Y|N"}))
    assert mined["flag"].broken == ("y",)
    found = profile.violations(df, "id", mined, {"flag": "Y|N"})
    assert found.count() == 51 and profile.violations(df, "id", mined).count() == 1


def test_columns_without_a_pattern(spark, rows):
    r = random.Random(1)
    df = spark.createDataFrame([(k, "".join(r.choice("Aa9-_ ") for _ in range(r.randrange(30)))) for k in range(300)], "id long, free string")
    mined = profile.mine(profile.mask_counts(df, None, ["free"]))
    assert mined["free"].level == "none" and profile.violations(df, "id", mined).count() == 0
    assert rows(profile.rare_masks(profile.mask_counts(df, None, ["free"]), mined)) == []
    one = {x.column_name: x for x in profile.profile(df).collect()}
    assert one["free"].level == "none" and one["free"].rare_rows == 0 and one["id"].level == "tail" and one["id"].dominant_masks == ["value"]
    assert profile.profile(df.limit(0)).where("column_name = 'free'").first().n_rows == 0


def test_profile_by_group(spark):
    data = [(1, k, f"{k % 700:06d}", 0.0 if k % 2 else -0.0) for k in range(5000)] + [(2, k % 30, "A-1", None) for k in range(60)] + [(None, 7, None, float("nan")), (None, 8, None, 1.0)]
    df = spark.createDataFrame(data, "load_id int, n int, code string, v double")
    got = {(r.grp, r.column_name): r for r in profile.profile(df, group="load_id").collect()}
    assert {k: (r.n_rows, r.n_nulls, r.n_distinct, r.least, r.greatest) for k, r in got.items()} == {
        (1, "n"): (5000, 0, 5000, "0", "4999"), (1, "code"): (5000, 0, 700, "000000", "000699"), (1, "v"): (5000, 0, 1, got[1, "v"].least, got[1, "v"].greatest),
        (2, "n"): (60, 0, 30, "0", "29"), (2, "code"): (60, 0, 1, "A-1", "A-1"), (2, "v"): (60, 60, 0, None, None),
        (None, "n"): (2, 0, 2, "7", "8"), (None, "code"): (2, 2, 0, None, None), (None, "v"): (2, 0, 2, "1.000000", "NaN"),
    }
    assert got[2, "code"].rare_rows == 60 and got[2, "code"].dominant_masks is None and got[1, "code"].rare_rows == 0 and got[1, "code"].level == "class"
    whole = {r.column_name: r for r in profile.profile(df).collect()}
    assert whole["n"].n_distinct == 5000 and whole["load_id"].n_nulls == 2 and whole["code"].rare_rows == 60


def test_patterns_say_what_masks_say(spark):
    """A value fits a mask's pattern exactly if it has that mask."""
    r = random.Random(12)
    values = ["".join(r.choice("AZazÄßéĳ019٣区ʰ\u0301\u200b-_ ?.$\n") for _ in range(r.randrange(7))) for _ in range(1500)] + ["Y", "N", "202401", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for level in profile.LEVELS:
        held = [(x.v, x.m) for x in df.select("v", profile.level_mask(df, "v", level).alias("m")).collect()]
        some = tuple(sorted({m for _, m in held}))[::3]
        fits = df.select("v", F.col("v").rlike(profile.mask_pattern(level, some)).alias("f")).collect()
        assert [x.f for x in fits] == [m in some for _, m in held], level
