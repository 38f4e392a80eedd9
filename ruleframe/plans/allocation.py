"""Weighted distribution of amounts over factor tables, with conservation.

Facts stay one lazy branch; factor tables are small, reduced to one share a key and target, and broadcast. What is
taken out of a row (``out``) and what is put in (``in``) add up to zero.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleframe.errors import RuleError
from ruleframe.functions.columns import amounts, blank, is_text, number, q, require
from ruleframe.functions.conditions import predicate
from ruleframe.operators import hierarchy
from ruleframe.operators.sizes import BROADCAST_ROWS, small
from ruleframe.operators.table import assign, group_keys
from ruleframe.operators.unify import union_relaxed
from ruleframe.storage import cut

# The label and trace columns; the labels are ``out`` and ``in``.
LABEL, TRACE = "dim_alclabel", "dim_alctrace"
#: Up to so many members the closure is made by the driver; above, by ``operators.hierarchy``.
MEMBERS_ON_DRIVER = 100_000


def base_members(metadata: DataFrame, dimension: str = "dimension", code: str = "element_code", is_base: str = "is_base", parent: str = "parent", base_flag: str = "Y", on_driver: int | None = None) -> DataFrame:
    """(``dimension``, ``ancestor``, ``base``): each summary member with all base members under it.

    What hangs on a base member is not reached through it. Repeated members and cycles are errors. Up to ``on_driver``
    members the closure is made by the driver, beyond by ``operators.hierarchy``; both give the same.
    """
    on_driver = MEMBERS_ON_DRIVER if on_driver is None else on_driver
    names = [dimension, code, is_base, parent]
    require(metadata, names, "metadata")
    rows = metadata.select(*[q(n) for n in names]).where(q(code).isNotNull())
    spark = metadata.sparkSession
    schema = "dimension string, ancestor string, base string"
    held = rows.limit(on_driver + 1).collect()
    if len(held) <= on_driver:
        base, children = {}, defaultdict(list)
        for d, c, b, p in held:
            if (d, c) in base:
                raise RuleError(f"member {c} of {d} is there twice")
            base[d, c] = b == base_flag
            if p is not None and str(p).strip():
                children[d, p].append(c)
        out = []
        for (d, c), is_leaf in base.items():
            if is_leaf:
                continue
            seen, stack = {c}, [c]
            while stack:
                for x in children[d, stack.pop()]:
                    if x in seen:
                        raise RuleError(f"member {c} of {d} lies on a cycle or is reached twice")
                    seen.add(x)
                    if base[d, x]:
                        out.append((d, c, x))
                    else:
                        stack.append(x)
        return spark.createDataFrame(out, schema)
    if rows.groupBy(dimension, code).count().where("count > 1").limit(1).count():
        raise RuleError("a member is there twice")
    flag = rows.select(q(dimension).alias("d"), q(code).alias("c"), q(is_base).alias("b"), q(parent).alias("p"))
    linked = flag.join(flag.select("d", F.col("c").alias("p"), (F.col("b") == base_flag).alias("under_base")), ["d", "p"], "left")
    tree = hierarchy.build(linked.withColumn("p", F.when(~F.coalesce(F.col("under_base"), F.lit(False)), F.col("p"))), "d", "c", "p")
    if tree.nodes.where("link_state <> 'tree'").limit(1).count():
        raise RuleError("the members have a cycle")
    pairs = tree.closure().where("distance > 0").join(flag.where(F.col("b") == base_flag).select(F.col("d").alias("dimension"), F.col("c").alias("descendant")), ["dimension", "descendant"])
    return pairs.select("dimension", "ancestor", F.col("descendant").alias("base"))


def expand_factors(factors: DataFrame, metadata: DataFrame, out_prefix: str = "out_", **names: str) -> DataFrame:
    """Factor rows with summary members of ``out_<dimension>`` replaced by their base members, and ``reg{p}`` by the base
    members of all members whose code begins with a match of ``p``. All else stays; equal rows collapse."""
    bridge = base_members(metadata, **names)
    code, dim, flag = names.get("code", "element_code"), names.get("dimension", "dimension"), names.get("is_base", "is_base")
    known = metadata.select(q(dim).alias("dimension"), q(code).alias("ancestor"), q(flag).alias("flag"))
    # every member with what it stands for: itself if base
    stands = bridge.unionByName(known.where(F.col("flag") == names.get("base_flag", "Y")).select("dimension", "ancestor", F.col("ancestor").alias("base")))
    have = {r[0] for r in known.select("dimension").distinct().collect()}
    for c in [c for c in factors.columns if c.startswith(out_prefix) and c[len(out_prefix) :] in have]:
        part = stands.where(F.col("dimension") == c[len(out_prefix) :]).select("ancestor", "base")
        pattern = F.regexp_extract(q(c), r"(?s)^reg\{(.*)\}$", 1)
        is_pattern = F.coalesce(q(c).rlike(r"(?s)^reg\{.*\}$"), F.lit(False))
        plain = factors.where(~is_pattern).join(small(part), q(c) == F.col("ancestor"), "left")
        plain = plain.withColumn(c, F.coalesce("base", q(c))).drop("ancestor", "base")
        if is_text(factors, c) and factors.where(is_pattern).limit(1).count():
            wild = factors.where(is_pattern).withColumn("__p", F.concat(F.lit("^(?:"), pattern, F.lit(")")))
            # the distinct patterns against the distinct members, then their base members by key
            patterns = small(cut(wild.select("__p").distinct()))
            met = part.select("ancestor").distinct().join(patterns, F.rlike(F.col("ancestor"), F.col("__p"))).join(part, "ancestor").select("__p", "base").distinct()
            wild = wild.join(met, "__p", "left").withColumn(c, F.coalesce("base", q(c))).drop("base", "__p")
            plain = plain.unionByName(wild)
        factors = plain.distinct()
    return factors


def shares(factors: DataFrame, keys: list[str], targets: list[str], rate: str = "rate") -> DataFrame:
    """(keys, targets, ``__share``): weights summed by key and target, without zeros, over the key's total.

    Weights that are no numbers don't count. A key without any weight, or with weights that sum to 0, has a null share.
    """
    require(factors, [*keys, *targets, rate], "factor table")
    cols = [*map(q, keys), *map(q, targets)]
    summed = factors.select(*cols, number(factors, rate).alias("__rate")).groupBy(*cols).agg(F.coalesce(F.sum("__rate"), F.lit(0.0)).alias("__w"))
    w = W.partitionBy(*map(q, keys)) if keys else W.partitionBy(F.lit(0))
    total, most = F.sum("__w").over(w), F.max(F.abs(F.col("__w"))).over(w)
    out = summed.withColumns({"__total": total, "__most": most, "__rn": F.row_number().over(w.orderBy(*map(q, targets)))})
    good = (F.col("__most") > 0) & (F.col("__total") != 0)
    return out.where((F.col("__w") != 0) & good | ~good & (F.col("__rn") == 1)).select(*cols, F.when(good, F.col("__w") / F.col("__total")).alias("__share"))


def allocate_basic(facts: DataFrame, factors: DataFrame, keys: list[str], targets: list[str], value_columns: list[str], rate: str = "rate", names: dict[str, str] | None = None, group_by: list[str] | None = None, group_by_exclude: list[str] | None = None, null_keys_match: bool = True, label: bool = True, share_column: str | None = None, assign_result: dict[str, Any] | None = None) -> DataFrame:
    """Facts that meet a factor key, taken out (label ``out``, amounts negated) and put in (``in``) by share.

    ``keys``: factor columns to meet the fact columns of the same name (or as ``names`` maps them); ``targets``: factor
    columns to set on the ``in`` rows, likewise named. Rows whose amounts all round to 0 at ten digits are dropped. A key
    met by facts but without a usable weight stops the query. ``share_column``: in-amount by original amount, of the
    amount column with the row's largest value.
    """
    names = names or {}
    name = lambda c: names.get(c, c)
    facts = amounts(facts, value_columns)
    if group_by or group_by_exclude:
        by = list(dict.fromkeys([*group_keys(facts, value_columns, group_by, group_by_exclude), *[name(k) for k in keys]]))
        facts = facts.groupBy(*map(q, by)).agg(*[F.sum(q(v)).alias(v) for v in value_columns])
    require(facts, [name(k) for k in keys], "fact table")
    table = shares(factors, keys, targets, rate)
    table = cut(table.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[q(t).alias(f"__t{i}") for i, t in enumerate(targets)], "__share"))
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if few else lambda x: x
    same = lambda i, k: q(name(k)).eqNullSafe(F.col(f"__k{i}")) if null_keys_match else q(name(k)) == F.col(f"__k{i}")
    on = reduce(lambda a, b: a & b, [same(i, k) for i, k in enumerate(keys)], F.lit(True))
    ids = [c for c in facts.columns if c not in value_columns]
    new = [name(t) for t in targets]
    target = {name(t): F.col(f"__t{i}") for i, t in enumerate(targets)}
    cover = F.when(F.col("__share").isNull(), F.raise_error(F.lit("a factor key met by facts has no usable weight")).cast("double")).otherwise(F.col("__share"))
    met = facts.join(hint(table), on).withColumn("__s", cover)
    put = met.select(*[target[c].alias(c) if c in target else q(c) for c in ids], *[target[t].alias(t) for t in new if t not in ids], *[(q(v) * F.col("__s")).alias(v) for v in value_columns], *[q(v).alias(f"__orig_{v}") for v in value_columns])
    once = hint(table.select(*[f"__k{i}" for i in range(len(keys))]).distinct()) if keys else None
    out = facts.join(once, on, "left_semi") if keys else facts.join(F.broadcast(table.limit(1).select()), F.lit(True))
    taken = out.select(*[q(c) for c in ids], *[F.lit(None).cast(put.schema[t].dataType).alias(t) for t in new if t not in ids], *[(F.lit(0.0) - q(v)).alias(v) for v in value_columns], *[q(v).alias(f"__orig_{v}") for v in value_columns])
    if share_column:
        orig = [q(f"__orig_{v}") for v in value_columns]
        top = orig[0] if len(orig) == 1 else F.greatest(*orig)
        part: Column = F.coalesce(*[F.when(o == top, F.try_divide(q(v), o)) for v, o in zip(value_columns, orig)])
        put, taken = put.withColumn(share_column, part), taken.withColumn(share_column, F.lit(None).cast("double"))
    both = [x.drop(*[f"__orig_{v}" for v in value_columns]) for x in (taken, put)]
    if label:
        both = [x.withColumn(LABEL, F.lit(v)) for x, v in zip(both, ("out", "in"))]
    result = union_relaxed(both).where(reduce(lambda a, b: a | b, [F.round(F.abs(q(v)), 10) >= 1e-10 for v in value_columns]))
    return assign(result, assign_result) if assign_result else result


def _valid_keys(df: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [q(n).isNotNull() & (q(n) != "") if is_text(df, n) else q(n).isNotNull() for n in names], F.lit(True))


def allocate_family(facts: DataFrame, rounds: list[tuple[list[str], list[str], DataFrame]], value_columns: list[str], rate: str = "rate", keep_label: bool = False, miss_ok: bool = True, names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Fallback rounds of (keys, targets, factors): a row is allocated in the first round whose keys it meets.

    Returns the result and the rows no round met. Null and '' keys meet nothing; a round without keys takes all that is
    left. The round of each row is found in one pass, by one broadcast join a round.
    """
    names = names or {}
    marked = facts
    for i, (keys, _, factors) in enumerate(rounds):
        if keys:
            hit = small(factors.select(*[q(k).alias(f"__h{i}_{j}") for j, k in enumerate(keys)]).distinct().withColumn(f"__hit{i}", F.lit(i)))
            on = reduce(lambda a, b: a & b, [q(names.get(k, k)) == F.col(f"__h{i}_{j}") for j, k in enumerate(keys)] + [_valid_keys(facts, [names.get(k, k) for k in keys])])
            marked = marked.join(hit, on, "left").drop(*[f"__h{i}_{j}" for j in range(len(keys))])
        else:
            marked = marked.withColumn(f"__hit{i}", F.lit(i))
    which = F.coalesce(*[F.col(f"__hit{i}") for i in range(len(rounds))], F.lit(-1)) if rounds else F.lit(-1)
    marked = marked.withColumn("__round", which).drop(*[f"__hit{i}" for i in range(len(rounds))])
    missing = marked.where("__round = -1").drop("__round")
    if not miss_ok and (n := missing.count()):
        raise RuleError(f"{n} rows are met by no round")
    done = []
    for i, (keys, targets, factors) in enumerate(rounds):
        one = allocate_basic(marked.where(F.col("__round") == i).drop("__round"), factors, keys, targets, value_columns, rate, names, null_keys_match=False, label=keep_label)
        if keep_label:
            one = one.withColumn(TRACE, F.lit(f"[自动]家族式分摊_次序{i + 1}, 分摊范围: {keys}"))
        done.append(one)
    return (union_relaxed(done) if done else facts.limit(0)), missing


def allocate(facts: DataFrame, factors: DataFrame, metadata: DataFrame | None, value_columns: list[str], rate: str = "rate", out_prefix: str = "out_", in_prefix: str = "in_", keep_label: bool = False, group_by: list[str] | None = None, group_by_exclude: list[str] | None = None, factor_query: dict | str | None = None, assign_result: dict[str, Any] | None = None, **metadata_names: str) -> DataFrame:
    """Allocation by a factor table ``out_<dim>...``, ``in_<dim>...``, ``rate``.

    The factor rows are filtered, expanded over the hierarchy, and split by which ``out_`` cells are blank (wildcards);
    each such pattern sees all facts, so a row may be allocated more than once; rows no pattern meets are not in the
    result. A pattern without ``out_`` cells meets everything.
    """
    if factor_query:
        factors = factors.where(predicate(factors, factor_query))
    if metadata is not None:
        factors = expand_factors(factors, metadata, out_prefix, **metadata_names)
    factors = cut(factors)  # small, and read once a pattern
    outs, ins = [[c for c in factors.columns if c.startswith(p)] for p in (out_prefix, in_prefix)]
    if not ins:
        raise RuleError(f"the factor table has no {in_prefix} column")
    factors = factors.withColumns({c: F.when(~blank(q(c)), q(c)) if is_text(factors, c) else q(c) for c in [*outs, *ins]})
    names = {c: c[len(out_prefix) :] for c in outs} | {c: c[len(in_prefix) :] for c in ins}
    shape = F.array(*[q(c).isNotNull() for c in outs]) if outs else F.array().cast("array<boolean>")
    filled = [F.count(q(c)).alias(f"f{i}") for i, c in enumerate(ins)]
    patterns = factors.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"), *filled).collect()
    facts = amounts(facts, value_columns)
    if group_by or group_by_exclude:
        by = list(dict.fromkeys([*group_keys(facts, value_columns, group_by, group_by_exclude), *[names[c] for c in outs]]))
        facts = facts.groupBy(*map(q, by)).agg(*[F.sum(q(v)).alias(v) for v in value_columns])
    done = []
    for p in sorted(patterns, key=lambda r: r["shape"], reverse=True):
        keys = [c for c, on in zip(outs, p["shape"]) if on]
        targets = []
        for i, c in enumerate(ins):
            if p[f"f{i}"] not in (0, p["n"]):
                raise RuleError(f"{c} is blank in some rows of a pattern")
            if p[f"f{i}"]:
                targets.append(c)
        if not targets:
            raise RuleError("a pattern sets no target")
        own = factors.where(reduce(lambda a, b: a & b, [q(c).isNotNull() if c in keys else q(c).isNull() for c in outs], F.lit(True)))
        done.append(allocate_family(facts, [(keys, targets, own)], value_columns, rate, keep_label, names=names)[0])
    result = union_relaxed(done) if done else facts.limit(0)
    return assign(result, assign_result) if assign_result else result


def conserved(result: DataFrame, value_columns: list[str], abs_delta: float = 5.0) -> tuple[DataFrame, Callable[[], None]]:
    """The result, and a check to call when it has been written: each amount must sum to 0 within ``abs_delta``."""
    seen = Observation()
    watched = result.observe(seen, *[F.coalesce(F.sum(q(v)), F.lit(0.0)).alias(f"s{i}") for i, v in enumerate(value_columns)])

    def verify() -> None:
        for i, v in enumerate(value_columns):
            if abs(seen.get[f"s{i}"] or 0.0) > abs_delta:
                raise RuleError(f"{v} does not balance: {seen.get[f's{i}']}")

    return watched, verify
