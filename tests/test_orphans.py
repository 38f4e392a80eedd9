import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ruleframe.operators import orphans, sizes

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def find(spark, members, uses, **options):
    m = spark.createDataFrame(members, "dimension string, element_code string, created_at timestamp_ntz, deleted_at timestamp_ntz, d string, valid int")
    u = spark.createDataFrame(uses, "row_id long, dim string, code string, at timestamp_ntz, n int")
    return orphans.find(m, [orphans.references("uses", u, "row_id", "code", "at", "dim")], **options)


@pytest.mark.parametrize("fits", [[True, True], [True, False, True], [False, False, False]])
def test_against_brute_force(spark, monkeypatch, fits):
    """All left over by broadcast; heavy keys by broadcast and the others by exchange; heavy keys salted."""
    answers = list(fits)
    monkeypatch.setattr(orphans, "_fits", lambda df, n: answers.pop(0))
    monkeypatch.setattr(orphans, "heavy_keys", lambda df, keys, n: sizes.heavy_keys(df, keys, n, 0.05, 5))
    r = random.Random(1)
    members = []
    for _ in range(60):
        a, b = r.randrange(200), r.choice([None, r.randrange(300)])
        members.append((r.choice("de"), f"k{r.randrange(15)}", day(a), None if b is None else day(b), "x", 1))
    uses = [(i, r.choice(["d", "e", None]), r.choice([f"k{r.randrange(20)}", "k1", "k1", "", "  ", None]), r.choice([None, *[day(r.randrange(300))] * 9]), 1) for i in range(700)]
    want = {}
    for i, d, c, t, _ in uses:
        if c is None or not c.strip():
            continue
        own = [m for m in members if m[0] == d and m[1] == c]
        if not own:
            want[i] = "missing"
        elif t is not None and not any(m[2] <= t and (m[3] is None or m[3] > t) for m in own):
            want[i] = "late" if all(m[2] > t for m in own) else "deleted"
    found = find(spark, members, uses)
    assert not answers
    assert {x.row_id: x.reason for x in found.rows.collect()} == want
    assert found.rows.count() == len(want)
    assert sum(x.n_orphans for x in found.counts.collect()) == len(want)


def test_empty_and_repeated(spark, rows):
    members = [("d", "a", day(0), day(5), "x", 1)] * 3 + [("d", "a", None, None, "x", 1)]
    uses = [(1, "d", "a", day(1), 1), (2, "d", "a", day(9), 1), (2, "d", "a", day(9), 1), (3, "d", "b", None, 1)]
    assert rows(find(spark, members, uses).rows) == [("uses", 2, "deleted", "202401"), ("uses", 2, "deleted", "202401"), ("uses", 3, "missing", "")]
    assert find(spark, [], uses).rows.count() == 4
    assert find(spark, members, []).rows.count() == 0


def test_size_counts_rows_and_elements(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, None), (3, [])], "k int, x array<int>")
    assert orphans._fits(df, 6) and not orphans._fits(df, 5) and orphans._fits(df.limit(0), 0)


def test_heavy_keys_are_few(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(1).alias("n"))
    assert [r.k for r in sizes.heavy_keys(df, ["k"], "n", 0.1, 10).collect()] == ["hot"]
