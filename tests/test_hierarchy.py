import random

import pytest

from ruleframe.operators import hierarchy

SCHEMA = "dimension string, element_code string, parent string, extra int"


def brute(links):
    """{(d, c): (root, depth, state)} by walking up from every member."""
    out = {}
    for d, c in links:
        seen, at = [], c
        while True:
            if at in seen:
                out[d, c] = ("", -1, "on_cycle" if at == c else "below_cycle")
                break
            seen.append(at)
            up = links[d, at]
            if up is None or not up.strip() or (d, up) not in links:
                out[d, c] = (at, len(seen) - 1, "tree")
                break
            at = up
        if out[d, c][2] == "below_cycle" and c in _cycle_of(links, d, c):
            out[d, c] = ("", -1, "on_cycle")
    return out


def _cycle_of(links, d, c):
    seen, at = [], c
    while at not in seen:
        seen.append(at)
        at = links[d, at]
    return seen[seen.index(at) :]


def forest(seed, n):
    r = random.Random(seed)
    links = {}
    for d in ("a", "b"):
        for i in range(n):
            p = r.choice([None, "", " ", "nobody", *[f"n{r.randrange(n)}"] * 3, *[f"n{max(0, i - 1)}"] * 4])
            links[d, f"n{i}"] = p
    return links


@pytest.mark.parametrize("bound", [100_000, 10])
def test_against_walking_up(spark, rows, monkeypatch, bound):
    monkeypatch.setattr(hierarchy, "RANK_IN_ONE_TASK", bound)
    links = forest(3, 60)
    data = [(d, c, p, 1) for (d, c), p in links.items()]
    built = hierarchy.build(spark.createDataFrame(data + data[:7] + [(None, "x", None, 1), ("a", None, "n1", 2)], SCHEMA))
    found = {(r.dimension, r.element_code): (r.root_code, r.depth, r.link_state) for r in built.nodes.collect()}
    assert found == brute(links)


def test_star_and_chain(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "RANK_IN_ONE_TASK", 20)
    data = [("s", "hub", None, 0)] + [("s", f"leaf{i}", "hub", 0) for i in range(300)]
    data += [("c", f"k{i:03}", f"k{i - 1:03}" if i else None, 0) for i in range(150)]
    built = hierarchy.build(spark.createDataFrame(data, SCHEMA))
    nodes = {(r.dimension, r.element_code): r for r in built.nodes.collect()}
    assert nodes["s", "hub"].n_descendants == 300 and nodes["s", "leaf7"].depth == 1
    assert nodes["c", "k149"].depth == 149 and nodes["c", "k000"].n_descendants == 149
    paths = {(r.dimension, r.element_code): r.path for r in built.paths().collect()}
    assert paths["c", "k003"] == "k000/k001/k002/k003" and paths["s", "leaf9"] == "hub/leaf9"
    pairs = built.closure()
    assert pairs.count() == sum(r.depth + 1 for r in nodes.values())
    for n in nodes.values():  # descendants lie inside the interval
        assert (n.exit_no - n.entry_no + 1) == 2 * (n.n_descendants + 1)


def test_cycles_only_and_empty(spark, rows):
    loop = spark.createDataFrame([("a", "x", "y", 0), ("a", "y", "x", 0), ("a", "self", "self", 0), ("a", "below", "self", 0)], SCHEMA)
    built = hierarchy.build(loop)
    states = {r.element_code: r.link_state for r in built.nodes.collect()}
    assert states == {"x": "on_cycle", "y": "on_cycle", "self": "on_cycle", "below": "below_cycle"}
    assert built.paths().count() == 0
    empty = hierarchy.build(loop.limit(0))
    assert empty.nodes.count() == 0 and empty.closure().count() == 0
