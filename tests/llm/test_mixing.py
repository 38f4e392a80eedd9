import math
import random

import pytest

from ruleframe.llm import mixing

S = "doc_id long, source string, text string, place int, block int"
T = "source string, target_share double, max_repeats int"


def test_targets_fit_or_not():
    have, goal = {"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5, "none": 0.2}
    w, e, total = mixing.temperature_weights(have, goal, {"a": 1, "b": 4, "none": 3})
    assert math.isclose(w["a"], 0.5) and math.isclose(total, 800) and math.isclose((1000 / 1100) ** e["a"], 0.5) and math.isclose((100 / 1100) ** e["b"], 0.5)
    w, e, total = mixing.temperature_weights(have, goal, {"a": 1, "b": 4, "none": 3}, 1100)
    assert math.isclose(w["b"] * total, 400, rel_tol=1e-6) and e["a"] > 1 > e["b"] > 0
    w, _, total = mixing.temperature_weights(have, goal, {"a": 1, "b": 1, "none": 3}, 5000)
    assert total == 1100 and math.isclose(w["a"], 1000 / 1100)
    assert mixing.temperature_weights({}, goal, {"a": 1, "b": 1, "none": 1})[0] == {}
    assert mixing.temperature_weights(have, goal, {"a": 0, "b": 1, "none": 1}, 50)[0] == {"b": 1.0}


def test_temperature_meets_an_entropy_or_the_limits():
    have = {"a": 700, "b": 200, "c": 100}
    for want in (1.2, 1.4, 1.58):
        w, e, _ = mixing.temperature_weights(have, None, dict.fromkeys(have, 50), 1000, want)
        assert math.isclose(mixing.entropy(w), want, abs_tol=1e-9) and len(set(e.values())) == 1 and 0 < e["a"] < 1
        assert math.isclose(w["a"] / w["b"], 3.5 ** e["a"])
    w, e, total = mixing.temperature_weights(have, None, {"a": 1, "b": 2, "c": 1}, 1000, 1.58)
    assert total == 1000 and math.isclose(w["c"], 0.1) and math.isclose(e["a"], 1)  # the limit of c stops it at once
    w, _, total = mixing.temperature_weights(have, None, {"a": 1, "b": 2, "c": 3}, None, 1.58)
    assert math.isclose(max(w[s] * total / (have[s] * n) for s, n in (("a", 1), ("b", 2), ("c", 3))), 1)


@pytest.mark.parametrize("total", [None, "all"])
def test_budgets_and_limits(spark, total):
    docs = [(i, "big", "some words to count here", 1, 2) for i in range(400)] + [(1000 + i, "small", "tokens " * (i % 7), 1, 2) for i in range(60)] + [(3000, None, "x", 1, 1), (None, "big", "x", 1, 1), (3001, "other", "x", 1, 1), (3002, "big", None, 1, 1)]
    frame = spark.createDataFrame(docs, S)
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.3, 2)], T)
    mixed = mixing.mix(frame, targets, total).cache()
    most = {"big": 1, "small": 3}
    assert mixed.where("copies < 1").count() == 0 and all(r.copies <= most[r.source] for r in mixed.collect())
    assert mixed.count() == mixed.select("doc_id").distinct().count()
    reached = {r.source: r.reached_share for r in mixing.shares(frame, targets, total).collect()}
    assert reached["absent"] == 0.0 and math.isclose(sum(reached.values()), 1.0)
    if total is None:
        assert abs(reached["big"] - 0.6) < 0.02  # of 0.6 : 0.4, without the absent source
    again = mixing.mix(frame, targets, total)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


@pytest.mark.parametrize("bits", [10, 2])
def test_budget_is_met_within_half_a_document(spark, monkeypatch, bits):
    """Against a walk along the hashed order; with two bits a level the block tree is deep."""
    monkeypatch.setattr(mixing, "BITS", bits)
    r = random.Random(6)
    docs = [(k if k % 50 else 7, s, r.randrange(1, 40)) for k, s in enumerate(r.choices("abc", (80, 15, 5), k=900))]
    rows = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumn("place", mixing._place(42)).cache()
    held = [tuple(x) for x in rows.select("source", "place", "n_tokens").collect()]
    for part in (0.0, 0.001, 0.3, 0.5, 0.999):
        budgets = {s: int(part * sum(n for x, _, n in held if x == s)) for s in "abc"}
        limits = mixing._limits(rows, mixing._blocks(rows, 0), budgets)
        for s, budget in budgets.items():
            by_place: dict[int, int] = {}
            for x, place, n in held:
                if x == s:
                    by_place[place] = by_place.get(place, 0) + n
            sums = [0]
            for place in sorted(by_place):
                sums.append(sums[-1] + by_place[place])
            taken = sum(n for x, place, n in held if x == s and place < limits.get(s, 0))
            assert taken in sums and abs(taken - budget) == min(abs(x - budget) for x in sums)


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], T)
    assert mixing.mix(spark.createDataFrame([], S), targets).count() == 0
    assert mixing.shares(spark.createDataFrame([], S), targets).first().reached_share == 0.0
    one = spark.createDataFrame([(1, "a", "x", 1, 1)], S)
    assert mixing.mix(one, targets.limit(0)).count() == 0
    assert [tuple(x) for x in mixing.mix(one, targets).collect()] == [(1, "a", 1, 1)]


def test_token_counts_cover_whole_texts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("word " * 100_000,)], "text string")
    n = [r.n_tokens for r in mixing.token_counts(df).collect()]
    with open(mixing.TOKENIZER, "rb") as file:
        encoder = mixing._encoder(file.read(), mixing.PATTERN)
    parts = encoder.encode_ordinary("hello world")
    assert encoder.decode(parts) == "hello world" and n[0] == len(parts)
    assert n[1:3] == [0, 0] and n[3] >= 100_000
