"""Parent-child rows to full hierarchies: peeling, Euler tours, list ranking.

``build`` numbers every node with the places where a depth-first walk of its tree enters and leaves it. All the rest
follows from those two numbers: depth, root, subtree size, ancestors, paths and descendants.

How it scales:

* Leaves are peeled in doubling strides (one level, then two, four, ...), so a chain of a million nodes takes twenty
  rounds. What never peels away are the cycles. Only parents take part, and few enough of them are peeled by one task.
* The tour is a linked list with two elements a node, one for a leaf. It is ranked by contraction: elements whose hash
  is smaller than that of both neighbours are spliced out, about a third each round, until at most ``rank_in_one_task``
  are left; these are ranked in one task, and the spliced ones are put back round by round. Work is linear in the
  nodes, and no key of any join repeats, so a parent with a third of all children is no hot spot.
* Siblings are consecutive numbers of one global sort, so no window runs over the children of a parent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleframe.storage import cut, numbered

#: A list of so many elements (about 50 bytes each) is ranked by one task; so many parents are searched for cycles by one.
RANK_IN_ONE_TASK = 100_000
#: A parent with more than this share of all nodes is looked up by broadcast; there are fewer than 1 / share such parents.
HEAVY_SHARE = 0.005


def _blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"^\s*$")


@dataclass(frozen=True)
class Hierarchy:
    """``nodes``: one row a member, see ``build``."""

    nodes: DataFrame

    def paths(self, separator: str = "/") -> DataFrame:
        """Each tree node with its ``path`` from the root, codes joined by ``separator``; nodes on or below cycles have none."""
        return _walk(self.nodes, _Paths(separator), "dimension string, element_code string, path string, depth int, root_code string, n_descendants long")

    def closure(self) -> DataFrame:
        """Each tree node with each node of its subtree, itself included: ``ancestor``, ``descendant``, ``distance``."""
        return _walk(self.nodes, _pairs, "dimension string, ancestor string, descendant string, distance int, is_leaf boolean")


def build(rows: DataFrame, dimension: str = "dimension", code: str = "element_code", parent: str = "parent", rank_in_one_task: int | None = None) -> Hierarchy:
    """The hierarchy of the members (``dimension``, ``code``) linked by ``parent``.

    ``nodes`` has ``dimension``, ``element_code``, ``root_code``, ``depth``, ``link_state`` (``tree``, ``on_cycle``,
    ``below_cycle``), ``entry_no``, ``exit_no`` and ``n_descendants``. A node's descendants are the nodes of the same
    dimension and root whose ``entry_no`` lies between its own two numbers.

    Defined results: rows with a null dimension or code are no members. Repeated rows are one member; of differing
    non-blank parents the smallest holds. A parent that is null, blank, or no member ends the path. Trees hanging on a
    cycle hang on the cycle's node; for these and the cycle ``root_code`` is '' and ``depth`` is -1. An empty table
    gives an empty result; other columns are ignored.
    """
    member = (
        rows.select(F.col(dimension).alias("d"), F.col(code).alias("c"), F.col(parent).alias("p"))
        .where(F.col("d").isNotNull() & F.col("c").isNotNull())
        .groupBy("d", "c")
        .agg(F.min(F.when(~_blank(F.col("p")), F.col("p"))).alias("p"))
    )
    m = numbered(member, ["d", "p", "c"])
    groups = cut(
        m.where("p is not null")
        .groupBy("d", "p")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
        .join(m.select("d", F.col("c").alias("p"), F.col("id").alias("pid"), F.col("p").alias("pp")), ["d", "p"])
    )
    at_once = RANK_IN_ONE_TASK if rank_in_one_task is None else rank_in_one_task
    cycle = _cycles(groups, at_once)
    groups = cut(_without_cycle_links(groups, cycle))
    tour = _tour(m, groups, cycle)
    return Hierarchy(_numbers(m, _ranked(tour, at_once)))


def _cycles_in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What ``_cycles`` gives, of one task's nodes: after as many steps up as there are nodes, all are on cycles or out."""
    whole = [b for b in batches if len(b)]
    if not whole:
        return
    x = pd.concat(whole, ignore_index=True).sort_values("v", ignore_index=True)
    v, out = x["v"].to_numpy(), len(x)
    wanted = x["up"].fillna(-1).to_numpy().astype(np.int64)
    at = np.minimum(np.searchsorted(v, wanted), out - 1)
    up = np.append(np.where(v[at] == wanted, at, out), out)
    for _ in range(out.bit_length()):
        up = up[up]
    left = np.unique(up[:-1])
    yield x.iloc[left[left < out]]


def _cycles(groups: DataFrame, at_once: int) -> DataFrame:
    """(v, up) of the nodes that reach themselves: what is left when no leaf is left to peel."""
    up = groups.select("d", F.col("p").alias("pp"), F.col("pid").alias("up"))
    live = cut(groups.select("d", "pp", F.col("pid").alias("v")).join(up, ["d", "pp"], "left").select("v", "up"))
    jump, n = live, live.count()
    if n <= at_once:
        return cut(live.repartition(1).mapInPandas(_cycles_in_one_task, "v long, up long"))
    while n:
        # v stays if a live node has it as its jump target; the target lies 1, 2, 4, ... levels up
        kept = jump.join(jump.select(F.col("up").alias("v")).where("v is not null").distinct(), "v", "left_semi")
        jump = cut(kept.join(kept.select(F.col("v").alias("up"), F.col("up").alias("next")), "up", "left").select("v", F.col("next").alias("up")))
        left = jump.count()
        if left == n:
            break
        n = left
    return cut(live.join(jump.select("v"), "v", "left_semi")) if n else live.limit(0)


def _without_cycle_links(groups: DataFrame, cycle: DataFrame) -> DataFrame:
    """The sibling ranges without the one child that closes a cycle; ``skip`` is that child where it lies in the middle."""
    g = groups.join(cycle.select(F.col("up").alias("pid"), F.col("v").alias("skip")), "pid", "left")
    first = F.when(F.col("first") == F.col("skip"), F.col("first") + 1).otherwise(F.col("first"))
    last = F.when(F.col("last") == F.col("skip"), F.col("last") - 1).otherwise(F.col("last"))
    return g.select("d", "p", "pid", "n", "skip", first.alias("first"), last.alias("last"))


def _tour(m: DataFrame, groups: DataFrame, cycle: DataFrame) -> DataFrame:
    """The tour as a list: element 2 id enters a node, 2 id + 1 leaves it; a leaf has only 2 id, for both.

    ``w`` counts elements and ``deep`` sums +1 for entering and -1 for leaving, from an element up to before ``nxt``.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    link = groups.select("d", "p", F.col("pid").alias("up"), F.col("last").alias("end"), "skip", (F.col("n") > F.lit(max(10_000, int(total * HEAVY_SHARE)))).alias("heavy"))
    heavy = F.broadcast(link.where("heavy"))
    linked = m.join(heavy, ["d", "p"]).unionByName(
        m.join(heavy.select("d", "p"), ["d", "p"], "left_anti").join(link.where("not heavy"), ["d", "p"], "left")
    )
    inner = groups.where("first <= last").select(F.col("pid").alias("id"), "first")
    n = linked.join(inner, "id", "left").join(cycle.select(F.col("v").alias("id"), F.lit(True).alias("loop")), "id", "left")
    after = F.when(F.col("id") == F.col("end"), 2 * F.col("up") + 1).otherwise(
        2 * F.when(F.col("id") + 1 == F.col("skip"), F.col("id") + 2).otherwise(F.col("id") + 1)
    )
    after = F.when(F.col("up").isNotNull() & F.col("loop").isNull(), after)
    label = F.when(after.isNull(), F.concat(F.when(F.col("loop"), "1").otherwise("0"), F.col("c")))
    leaf = F.struct((2 * F.col("id")).alias("e"), after.alias("nxt"), F.lit(2).cast("long").alias("w"), F.lit(0).cast("long").alias("deep"), label.alias("root"))
    enter = F.struct((2 * F.col("id")).alias("e"), (2 * F.col("first")).alias("nxt"), F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("deep"), F.lit(None).cast("string").alias("root"))
    leave = F.struct((2 * F.col("id") + 1).alias("e"), after.alias("nxt"), F.lit(1).cast("long").alias("w"), F.lit(-1).cast("long").alias("deep"), label.alias("root"))
    return n.select(F.inline(F.when(F.col("first").isNull(), F.array(leaf)).otherwise(F.array(enter, leave))))


def _rank_in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    whole = [b for b in batches if len(b)]
    if not whole:
        return
    x = pd.concat(whole, ignore_index=True).sort_values("e", ignore_index=True)
    e, end = x["e"].to_numpy(), x["nxt"].isna().to_numpy()
    nxt = np.where(end, np.arange(len(x)), np.searchsorted(e, x["nxt"].fillna(-1).to_numpy().astype(np.int64)))
    w, deep = x["w"].to_numpy().copy(), x["deep"].to_numpy().copy()
    more = ~end
    while more.any():
        w, deep = np.where(more, w + w[nxt], w), np.where(more, deep + deep[nxt], deep)
        more, nxt = more & more[nxt], nxt[nxt]
    yield pd.DataFrame({"e": e, "w": w, "deep": deep, "root": x["root"].to_numpy()[nxt]})[~end]


def _ranked(tour: DataFrame, at_once: int) -> DataFrame:
    """For each element ``w`` and ``deep`` summed up to the end of its list, and the ``root`` label at that end."""
    live, spliced = cut(tour), []
    while live.where("nxt is not null").count() > at_once:
        mix = lambda c, k=len(spliced): F.xxhash64(c, F.lit(k))
        on, ends = F.col("nxt").isNotNull(), F.col("nxt").isNull()
        falls = on & (mix(F.col("e")) > mix(F.col("nxt")))
        small = live.where(ends | (mix(F.col("e")) < mix(F.col("nxt")))).select(*[F.col(c).alias(f"s_{c}") for c in live.columns])
        # an element is either in the part that may take its successor in, or in the part that may be taken in
        met = live.where(falls).join(small, F.col("nxt") == F.col("s_e"), "full")
        alone = F.col("s_e").isNull()
        both = lambda c: F.when(alone, F.col(c)).otherwise(F.col(c) + F.col(f"s_{c}"))
        out = F.struct("e", F.when(alone, F.col("nxt")).otherwise(F.col("s_nxt")).alias("nxt"), both("w").alias("w"), both("deep").alias("deep"), F.when(alone, F.col("root")).otherwise(F.col("s_root")).alias("root"), F.lit(False).alias("gone"))
        own = F.struct(F.col("s_e").alias("e"), F.col("s_nxt").alias("nxt"), F.col("s_w").alias("w"), F.col("s_deep").alias("deep"), F.col("s_root").alias("root"), F.col("e").isNotNull().alias("gone"))
        kept = F.filter(F.array(F.when(F.col("e").isNotNull(), out), F.when(F.col("s_e").isNotNull(), own)), lambda x: x.isNotNull())
        step = cut(met.select(F.inline(kept)))
        spliced.append(step.where("gone").drop("gone"))
        live = step.where("not gone").drop("gone")
    ends = live.where("nxt is null")
    rest = live.where("nxt is not null")
    last = rest.unionByName(ends.join(rest.select(F.col("nxt").alias("e")), "e", "left_semi"))
    ranked = last.repartition(1).mapInPandas(_rank_in_one_task, "e long, w long, deep long, root string")
    done = cut(ranked.unionByName(ends.select("e", "w", "deep", "root")))
    for gone in reversed(spliced):
        rest = done.select(F.col("e").alias("nxt"), F.col("w").alias("r_w"), F.col("deep").alias("r_deep"), F.col("root").alias("r_root"))
        back = gone.join(rest, "nxt").select("e", (F.col("w") + F.col("r_w")).alias("w"), (F.col("deep") + F.col("r_deep")).alias("deep"), F.col("r_root").alias("root"))
        done = cut(done.unionByName(back).unionByName(gone.where("nxt is null").select("e", "w", "deep", "root")))
    return done


def _numbers(m: DataFrame, ranked: DataFrame) -> DataFrame:
    at = ranked.groupBy(F.shiftright("e", 1).alias("id")).agg(
        F.max(F.when(F.col("e") % 2 == 0, F.struct("w", "deep", "root"))).alias("i"),
        F.max(F.when(F.col("e") % 2 == 1, F.col("w"))).alias("o"),
    )
    n = m.join(at, "id")
    loop, code = F.substring("i.root", 1, 1) == "1", F.expr("substring(i.root, 2)")
    out = F.coalesce(F.col("o"), F.col("i.w") - 1)
    own = loop & (code == F.col("c")) & (F.col("i.deep") == 0)
    return n.select(
        F.col("d").alias("dimension"),
        F.col("c").alias("element_code"),
        F.when(loop, "").otherwise(code).alias("root_code"),
        F.when(loop, -1).otherwise(-F.col("i.deep")).cast("int").alias("depth"),
        F.when(own, "on_cycle").when(loop, "below_cycle").otherwise("tree").alias("link_state"),
        (-F.col("i.w")).alias("entry_no"),
        (-out).alias("exit_no"),
        F.shiftright(F.col("i.w") - out - 1, 1).alias("n_descendants"),
    )


class _Paths:
    def __init__(self, separator: str) -> None:
        self.separator = separator

    def __call__(self, stack: list, row) -> list[tuple]:
        return [(row.d, row.c, self.separator.join([*(x[1] for x in stack), row.c]), len(stack), row.root, row.n)]


def _pairs(stack: list, row) -> list[tuple]:
    n = len(stack)
    return [*((row.d, x[1], row.c, n - k, row.n == 0) for k, x in enumerate(stack)), (row.d, row.c, row.c, 0, row.n == 0)]


def _walk(nodes: DataFrame, emit, schema: str) -> DataFrame:
    """Run along the tours, sorted by tree and entry, with the open intervals (the ancestors) on a stack.

    A partition that starts inside a tree gets the ancestors of its first node along; they are found by their
    intervals, against one boundary row a partition.
    """
    order = ["d", "root", "i"]
    rows = nodes.where("link_state = 'tree'").select(
        F.col("dimension").alias("d"), F.col("root_code").alias("root"), F.col("entry_no").alias("i"), F.col("exit_no").alias("o"), F.col("element_code").alias("c"), F.col("n_descendants").alias("n")
    )
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    first = rows.groupBy("part").agg(F.min(F.struct(*order)).alias("f")).select("part", F.col("f.d").alias("d"), F.col("f.root").alias("root"), F.col("f.i").alias("at"))
    open_there = rows.drop("part").join(F.broadcast(first), ["d", "root"]).where("i < at and o > at").drop("at").withColumn("seed", F.lit(True))
    both = rows.withColumn("seed", F.lit(False)).unionByName(open_there).repartitionByRange(parts, "part").sortWithinPartitions("part", *order)
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple] = []
        at, out = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                here = (row.part, row.d, row.root)
                if here != at:
                    stack, at = [], here
                while stack and stack[-1][0] < row.i:
                    stack.pop()
                if not row.seed:
                    out += emit(stack, row)
                stack.append((row.o, row.c))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return both.mapInPandas(run, schema)
