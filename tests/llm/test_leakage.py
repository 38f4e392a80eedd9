import random

import pytest

from ruleframe.llm import leakage


def edit(pattern, text):
    """The least edit distance of the pattern to any stretch of the text, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers_distance():
    r = random.Random(4)
    for _ in range(400):
        a = [r.choice("abc") for _ in range(r.randrange(1, 15))]
        b = [r.choice("abcd") for _ in range(r.randrange(0, 30))]
        assert leakage.myers(a, b) == edit(a, b)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_against_brute_force(spark, monkeypatch, bound):
    """Items held by tasks, and items exchanged."""
    monkeypatch.setattr(leakage, "WORDS_IN_A_TASK", bound)
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, say(r.randrange(3, 25))) for i in range(12)] + [(99, say(4)), (98, say(2))]
    docs = []
    for d in range(60):
        ws = say(r.randrange(0, 30))
        if d % 2:
            source = r.choice(items)[1]
            part = list(source[r.randrange(4) :])
            if part and d % 3:
                part[r.randrange(len(part))] = "other"
            ws = ws[:10] + part + ws[10:]
        docs.append((d, ", ".join(w.upper() if r.random() < 0.3 else w for w in ws)))
    window, budget = 6, 1
    want = {}
    for d, text in docs:
        for i, ws in items:
            windows = [ws[k : k + window] for k in range(len(ws) - window + 1)] or [ws]
            far = min((edit(w, leakage.words(text)) for w in windows), default=9)
            if far <= (budget if len(ws) >= window else 0):
                want[d, i] = far
    assert 0 in want.values() and 1 in want.values()
    frame = spark.createDataFrame(docs + [(None, "x"), (100, None), (101, "")], "doc_id long, text string")
    given = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items] + [(None, "a"), (7000, None), (7001, "")], "item_id long, text string")
    found = leakage.find_leaks(frame, given, window=window, budget=budget).collect()
    assert {(x.doc_id, x.item_id): x.distance for x in found} == want and len(found) == len(want)


@pytest.mark.parametrize("bound", [500_000, 50])
def test_repeats_and_empty(spark, monkeypatch, bound):
    monkeypatch.setattr(leakage, "WORDS_IN_A_TASK", bound)
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text) for i in range(5)], "item_id long, text string")
    assert leakage.find_leaks(docs, items).distinct().count() == 5
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0 and leakage.find_leaks(docs.limit(0), items).count() == 0
    assert leakage.find_leaks(docs, spark.createDataFrame([(1, "w39"), (2, "w39 w40"), (3, "")], items.schema)).select("item_id", "item_words").distinct().collect() == [(1, 1)]


def test_same_on_the_tables_either_way(spark, monkeypatch):
    """All documents and items: exchanged items give what held ones give, distances included."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "eval_item"))
    held = {tuple(r) for r in leakage.find_leaks(docs, items).collect()}
    monkeypatch.setattr(leakage, "WORDS_IN_A_TASK", 0)
    assert held and {tuple(r) for r in leakage.find_leaks(docs, items).collect()} == held


def test_very_long_text(spark):
    passage = " ".join(f"needle{i}" for i in range(13))
    docs = spark.createDataFrame([(1, "hay " * 300_000 + passage + " hay" * 300_000)], "doc_id long, text string")
    items = spark.createDataFrame([(5, passage)], "item_id long, text string")
    assert leakage.find_leaks(docs, items).first().distance == 0


def test_near_copies_all_found_on_whole_tables(spark):
    """Edit distance 1 enumerated another way: equal after one word is left out of either side, or of both at one place."""
    def without(ws):
        return [(k, *ws[:k], *ws[k + 1 :]) for k in range(len(ws))]

    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "eval_item"))
    whole, changed, longer = {}, {}, {}
    for i, text in items.select("item_id", "text").collect():
        ws = leakage.words(text)
        for k in range(len(ws) - 12):
            w = tuple(ws[k : k + 13])
            whole.setdefault(w, set()).add(i)
            for x in without(w):
                changed.setdefault(x, set()).add(i)
                longer.setdefault(x[1:], set()).add(i)
    want = set()
    for d, text in docs.where("text is not null").select("doc_id", "text").collect():
        ws, found = leakage.words(text), set()
        for k in range(len(ws)):
            for x in without(ws[k : k + 13]) if len(ws) - k >= 13 else ():
                found |= changed.get(x, set())
            found |= longer.get(tuple(ws[k : k + 12]), set())
            for x in without(ws[k : k + 14]) if len(ws) - k >= 14 else ():
                found |= whole.get(x[1:], set())
        want |= {(d, i) for i in found}
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, items).where("item_words >= 13").collect()}
    assert len(want) > 20 and got == want
