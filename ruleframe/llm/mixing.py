"""Mixing sources to target weights by temperature, within repetition limits.

A source's weight is its natural token share raised to an exponent, normalised. Two ways lead the exponents from 1 (the
natural mix) by a temperature ``a`` from 0 to 1:

* without targets, all sources have the exponent ``1 - a``: at 1 they are equal;
* with targets, each source has its own, ``1 + a (e - 1)``, where ``e`` is the one at which its share becomes its target:
  at 1 the weights are the targets, which one exponent for all cannot reach.

``a`` is bisected to the largest value at which no source needs more repeats than it may have for the total asked for
or, if a target entropy is given, to that entropy. Without a given total, the total itself is bisected to the largest at
which the limits allow ``a`` = 1.

Weights are realised by budgeted block permutations: whole passes over a source first, then part of one more pass over
its documents in a hashed order. That order is a tree of blocks of 1,024; the block in which the budget ends is cut again
until it holds one document, so block sizes follow the tokens at any size of the corpus. What comes out is one limit a
source on the hashed order. No source is sorted, gathered or ranked.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleframe.storage import cut

#: Each level of the block tree takes so many bits of the hashed order.
BITS, ORDER_BITS = 10, 62
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoder(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``documents`` with ``n_tokens``, the tokens of the whole text in a public tokenizer; 0 for null.

    The driver reads the vocabulary file (a megabyte) and broadcasts it; executors need no file of their own.
    """
    with open(tokenizer, "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(shared.value, pattern).encode_ordinary
        for b in batches:
            yield b.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return documents.withColumn("n_tokens", F.pandas_udf(run, "long")(F.col(text)))


def entropy(weights: dict[str, float]) -> float:
    """In bits."""
    return -sum(w * math.log2(w) for w in weights.values() if w > 0)


def _bisect(holds, low: float, high: float) -> float:
    """The largest value at which a condition holds that holds at ``low`` and fails from some value on."""
    if holds(high):
        return high
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def exponents(available: dict[str, int], target: dict[str, float] | None, a: float) -> dict[str, float]:
    """The exponent of each source's natural token share at temperature ``a``."""
    whole = sum(available.values())
    if target is None or len(available) == 1:
        return {s: 1 - a for s in available}
    return {s: 1 + a * (math.log(target[s]) / math.log(n / whole) - 1) for s, n in available.items()}


def powered(available: dict[str, int], exponent: dict[str, float]) -> dict[str, float]:
    """Natural token shares raised to their exponents, normalised."""
    whole = sum(available.values())
    raw = {s: math.exp(exponent[s] * math.log(n / whole)) for s, n in available.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def temperature_weights(available: dict[str, int], target: dict[str, float] | None, repeats: dict[str, int], total: float | None = None, goal_entropy: float | None = None) -> tuple[dict[str, float], dict[str, float], float]:
    """(weights, exponents, total) over the sources that have tokens, may be used and, if there are targets, have one.

    ``total`` None: the largest total at which the weights fit. If no temperature fits a given total, it is cut to
    what the limits allow at all, and sources at their limit leave the rest to the others in proportion to their goals.
    """
    live = [s for s in (target if target is not None else available) if available.get(s, 0) > 0 and repeats.get(s, 0) > 0 and (target is None or target[s] > 0)]
    if not live:
        return {}, {}, 0.0
    have = {s: available[s] for s in live}
    goal = None if target is None else {s: target[s] / sum(target[x] for x in live) for s in live}
    most = {s: have[s] * repeats[s] for s in live}
    at = lambda a: powered(have, exponents(have, goal, a))
    fits = lambda a, size: all(w * size <= most[s] * (1 + 1e-12) for s, w in at(a).items())
    top = 1.0
    if goal_entropy is not None:
        # entropy rises with the temperature where all sources share it; with targets the first crossing is taken
        top = _bisect(lambda a: entropy(at(a)) <= goal_entropy, 0.0, 1.0)
    if total is None:
        total = _bisect(lambda size: fits(top, size), 0.0, float(sum(most.values())))
    if fits(top, total):
        return at(top), exponents(have, goal, top), total
    if fits(0.0, total):
        a = _bisect(lambda x: fits(x, total), 0.0, top)
        return at(a), exponents(have, goal, a), total
    # more than the natural mix can give: sources at their limit stay there, the others share the rest
    total, wish, fixed = min(total, float(sum(most.values()))), goal or at(top), {}
    while len(fixed) < len(live):
        rest = {s: wish[s] for s in live if s not in fixed}
        left = total - sum(fixed.values())
        over = [s for s in rest if left * rest[s] / sum(rest.values()) > most[s]]
        if not over:
            fixed |= {s: left * w / sum(rest.values()) for s, w in rest.items()}
            break
        fixed |= {s: float(most[s]) for s in over}
    weights = {s: fixed[s] / sum(fixed.values()) for s in live}
    whole = sum(have.values())
    return weights, {s: math.log(w) / math.log(have[s] / whole) if 0 < have[s] < whole else 1.0 for s, w in weights.items()}, sum(fixed.values())


def _place(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - ORDER_BITS)


def _blocks(rows: DataFrame, level: int) -> list:
    """Tokens and documents of each block of a level, by source: at most 1,024 blocks a source reach the driver."""
    block = F.shiftright("place", max(0, ORDER_BITS - BITS * (level + 1)))
    return sorted(tuple(r) for r in rows.groupBy("source", block.alias("block")).agg(F.sum("n_tokens").alias("of"), F.count("*").alias("n")).collect())


def _limits(rows: DataFrame, first: list, budgets: dict[str, int]) -> dict[str, int]:
    """For each source the place in its hashed order before which documents are taken once more, so that their tokens
    come nearest to its budget. The block in which a budget ends is cut into 1,024 until it holds one document."""
    limit: dict[str, int] = {}
    state = {s: 0 for s, b in budgets.items() if b > 0}  # tokens before the block that is looked at
    level, found, live = 0, first, rows
    while state:
        shift = max(0, ORDER_BITS - BITS * (level + 1))
        chosen: dict[str, int] = {}
        for s, block, of, n in found:
            if s not in state or s in chosen or s in limit:
                continue
            if state[s] + of < budgets[s]:
                state[s] += of
            elif n == 1 or shift == 0:  # one document, or several of one id: the nearer side
                limit[s] = (block + (2 * state[s] + of <= 2 * budgets[s])) << shift
            else:
                chosen[s] = block
        for s in [s for s in state if s not in chosen]:
            limit.setdefault(s, 1 << ORDER_BITS)
            del state[s]
        if state:
            inside = [(F.col("source") == s) & (F.shiftright("place", shift) == block) for s, block in chosen.items()]
            live = live.where(reduce(lambda a, b: a | b, inside))
            level += 1
            found = _blocks(live, level)
    return limit


def _plan(documents: DataFrame, targets: DataFrame, total: float | str | None, tokenizer: str, seed: int, goal_entropy: float | str | None) -> tuple[DataFrame, list[tuple]]:
    """The documents with their sizes, and one row a source: exponent, whole passes, limit of the last part."""
    goals = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share is not null and max_repeats is not null").collect()}
    given = documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & F.col("source").isin(*goals)) if goals else documents.limit(0)
    sized = cut(token_counts(given.select("doc_id", "source", "text"), tokenizer=tokenizer).drop("text").withColumn("place", _place(seed)).where("n_tokens > 0"))
    first = _blocks(sized, 0)
    have: dict[str, int] = {}
    for s, _, of, _ in first:
        have[s] = have.get(s, 0) + of
    shares_, repeats = {s: g[0] for s, g in goals.items()}, {s: g[1] for s, g in goals.items()}
    size = float(sum(have.values())) if total == "all" else total
    if goal_entropy == "target":  # one temperature for all sources, as even as the targets are
        live = {s: w for s, w in shares_.items() if w > 0 and have.get(s)}
        goal = entropy({s: w / sum(live.values()) for s, w in live.items()})
        weights, powers, size = temperature_weights(have, None, repeats, size, goal)
    else:
        weights, powers, size = temperature_weights(have, shares_, repeats, size, goal_entropy)
    budgets = {s: min(round(w * size), have[s] * repeats[s]) for s, w in weights.items()}
    limits = _limits(sized, first, {s: b % have[s] for s, b in budgets.items()})
    return sized, [(s, float(powers[s]), b // have[s], limits.get(s, 0)) for s, b in budgets.items()]


def _used(sized: DataFrame, plan: list[tuple]) -> DataFrame:
    rows = sized.join(F.broadcast(sized.sparkSession.createDataFrame(plan, "source string, exponent double, passes long, limit long")), "source")
    extra = F.when(F.col("place") < F.col("limit"), 1).otherwise(0)
    return rows.select("doc_id", "source", "n_tokens", (F.col("passes") + extra).alias("copies")).where("copies > 0")


def mix(documents: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 42, tokenizer: str = TOKENIZER, goal_entropy: float | str | None = None) -> DataFrame:
    """(``doc_id``, ``source``, ``n_tokens``, ``copies``): how often each document is used (at least once).

    ``targets`` has ``source``, ``target_share``, ``max_repeats``, one row a source. ``total`` is in tokens, ``"all"``
    for as many as the sources have, None for the largest at which the shares can be met. ``goal_entropy``: bits, or
    ``"target"`` for one temperature for all sources, up to the entropy of the target shares. A source's budget is met
    to within half a document. Documents without id, source, target or tokens are not used; an empty table gives none.
    """
    return _used(*_plan(documents, targets, total, tokenizer, seed, goal_entropy))


def shares(documents: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 42, tokenizer: str = TOKENIZER, goal_entropy: float | str | None = None) -> DataFrame:
    """One row a source of ``targets``: ``target_share``, ``max_repeats``, ``exponent`` of its natural share, ``tokens_used``
    with repeats, ``reached_share``, ``documents_used``, ``most_copies``. Sources that give nothing are there with zeros."""
    sized, plan = _plan(documents, targets, total, tokenizer, seed, goal_entropy)
    used = _used(sized, plan).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.count("*").alias("documents_used"), F.max("copies").alias("most_copies"))
    powers = F.broadcast(sized.sparkSession.createDataFrame([p[:2] for p in plan], "source string, exponent double"))
    joined = targets.select("source", "target_share", "max_repeats").join(powers, "source", "left").join(used, "source", "left").fillna(0, ["tokens_used", "documents_used", "most_copies"])
    whole = F.sum("tokens_used").over(W.partitionBy(F.lit(0)))  # one row a source
    return joined.withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens_used"), whole), F.lit(0.0)))
