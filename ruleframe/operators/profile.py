"""Column profiles by mined character-class masks, and departures of a load from the one before it.

A value's mask replaces each character by its class. Masks are generalised in three steps, each coarser than the last:

* ``tail``: classes, but the last two characters as they are, so short codes and the endings of longer ones stay apart;
* ``class``: every character by its class;
* ``runs``: ``class`` with each run of one class shortened to one sign.

A column is judged at the finest step at which its dominant masks cover nearly all its values; a column that no step
covers has no pattern, and nothing in it is rare. Masks are few where values are many: one pass counts them by group,
column and mask with map-side partial counts, and null shares, dominant masks, rare masks and the divergence of two loads
all come from those counts. Medians come from a radix selection that narrows an interval by counting; no pass gathers or
sorts the values of a load.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleframe.functions.columns import plain_text, q
from ruleframe.operators.sizes import small
from ruleframe.storage import cut

LEVELS = ("tail", "class", "runs")
#: A mask is dominant if this share of a column's non-null values has it; a column has at most 1 / share such masks.
DOMINANT_SHARE = 0.02
#: A step describes a column if its dominant masks have this share of the non-null values.
COVER = 0.9
#: Each pass of the median's selection cuts an interval into so many parts.
PARTS = 4096

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_CLASSES = ((r"\p{Lu}", "A"), (r"\p{Ll}", "a"), (r"[\p{Lo}\p{Lm}\p{Lt}\p{M}]", "w"), (r"[\p{Nd}&&[^0-9]]", "d"), (r"[\p{Cf}\x{80}-\x{9f}]", "?"))


def mask(value: Column) -> Column:
    """The class mask of a text of any length; null stays null.

    ``A`` and ``a`` stand for letters, ``9`` for an ASCII digit, ``d`` for another digit, ``w`` for a letter without
    case, ``?`` for an invisible character beyond ASCII; all else stands for itself.
    """
    ascii_only = F.octet_length(value) == F.char_length(value)
    plain = F.translate(value, _UPPER + _LOWER + _DIGIT, "A" * 26 + "a" * 26 + "9" * 10)
    wide = reduce(lambda c, x: F.regexp_replace(c, *x), _CLASSES, plain)
    return F.when(ascii_only, F.mask(value, F.lit("A"), F.lit("a"), F.lit("9"))).otherwise(wide)


def _at(level: str, classes: Column, tail: Column) -> Column:
    """The mask at a step, from the class mask and the value's last two characters."""
    if level == "class":
        return classes
    if level == "runs":
        return F.regexp_replace(classes, r"([Aa9wd?])\1+", "$1")
    return F.concat(F.substring(classes, F.lit(1), F.length(classes) - F.length(tail)), tail)


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def level_mask(df: DataFrame, column: str, level: str) -> Column:
    """The mask of a column's values at a step; values of other kinds than text have ``value`` (``nan`` for NaN)."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return _at(level, mask(q(column)), F.substring(q(column), -2, 2))
    value = F.when(F.isnan(q(column)), "nan").otherwise("value") if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit("value")
    return F.when(q(column).isNotNull(), value)


def _conforms(column: Column, form: str) -> Column:
    return column.rlike(rf"\A(?:{form})\z")


def mask_counts(df: DataFrame, group: str | None, columns: list[str] | None = None, declared: dict[str, str] | None = None) -> DataFrame:
    """(``grp``, ``column_name``, ``mask``, ``tail``, ``n``, ``n_bad``): how often each mask, null included, occurs by group.

    ``mask`` is the class mask, ``tail`` the last two characters; ``n_bad`` counts the values that break the form
    declared for the column. Texts are counted by mask; all other columns by one aggregate over nulls and NaN.
    """
    columns = [c for c in df.columns if c != group] if columns is None else columns
    declared = declared or {}
    g = q(group) if group else F.lit(0)
    parts = []
    if texts := [c for c in columns if _is_text(df, c)]:
        bad = lambda c: (q(c).isNotNull() & ~_conforms(q(c), declared[c])).cast("long") if c in declared else F.lit(0).cast("long")
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), q(c).alias("v"), bad(c).alias("bad")) for c in texts])
        rows = df.select(g.alias("grp"), F.inline(cells))
        parts.append(rows.groupBy("grp", "column_name", mask(F.col("v")).alias("mask"), F.substring("v", -2, 2).alias("tail")).agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad")))
    if others := [c for c in columns if c not in texts]:
        signs = [(c, s) for c in others for s in ("value", "nan")]
        aggs = [F.sum((level_mask(df, c, "class") == s).cast("long")).alias(f"k{i}") for i, (c, s) in enumerate(signs)]
        one = df.groupBy(g.alias("grp")).agg(F.count("*").alias("n"), *aggs)
        n = lambda i: F.coalesce(F.col(f"k{i}"), F.lit(0))
        cells = [F.struct(F.lit(c).alias("column_name"), F.lit(s).alias("mask"), n(i).alias("n")) for i, (c, s) in enumerate(signs)]
        cells += [F.struct(F.lit(c).alias("column_name"), F.lit(None).cast("string").alias("mask"), (F.col("n") - n(2 * k) - n(2 * k + 1)).alias("n")) for k, c in enumerate(others)]
        counted = one.select("grp", F.inline(F.array(*cells))).where("n > 0")
        parts.append(counted.select("grp", "column_name", "mask", F.when(F.col("mask").isNotNull(), F.substring("mask", -2, 2)).alias("tail"), "n", F.lit(0).cast("long").alias("n_bad")))
    if not parts:
        raise ValueError("no columns to profile")
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Pattern:
    """What is mined for one column: the step it is judged at (``none``: no pattern) and its dominant masks."""

    level: str
    masks: tuple[str, ...]
    broken: tuple[str, ...] = ()
    """Dominant masks that some value breaking the declared form has; their values are checked one by one."""


def mine(counts: DataFrame, share: float = DOMINANT_SHARE, cover: float = COVER) -> dict[str, Pattern]:
    """The pattern of each column in ``mask_counts``.

    The driver gets the dominant masks only, at most 1 / ``share`` a column and step, whatever the number of rows.
    A column without non-null values has no pattern.
    """
    whole = {r["column_name"]: r["of"] for r in counts.groupBy("column_name").agg(F.coalesce(F.sum(F.when(F.col("mask").isNotNull(), F.col("n"))), F.lit(0)).alias("of")).collect()}
    if not whole:
        return {}
    steps = F.array(*[F.struct(F.lit(k).alias("k"), _at(level, F.col("mask"), F.col("tail")).alias("m")) for k, level in enumerate(LEVELS)])
    per = counts.where("mask is not null").select("column_name", "n", "n_bad", F.inline(steps)).groupBy("column_name", "k", "m").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("bad"))
    least = reduce(lambda w, x: w.when(F.col("column_name") == x[0], float(x[1])), whole.items(), F.when(F.lit(False), 0.0))
    top = sorted(per.where(F.col("n") / least >= share).collect(), key=lambda r: (r["k"], r["m"]))
    found = {}
    for c, of in whole.items():
        for k, level in enumerate(LEVELS):
            own = [r for r in top if r["column_name"] == c and r["k"] == k]
            if own and sum(r["n"] for r in own) >= cover * of:
                found[c] = Pattern(level, tuple(r["m"] for r in own if not r["bad"]), tuple(r["m"] for r in own if r["bad"]))
                break
        else:
            found[c] = Pattern("none", ())
    return found


_SIGNS = {"A": r"\p{Lu}", "a": r"\p{Ll}", "9": "[0-9]", "d": r"[\p{Nd}&&[^0-9]]", "w": r"[\p{Lo}\p{Lm}\p{Lt}\p{M}]", "?": r"[\p{Cf}\x{80}-\x{9f}?]"}


def mask_pattern(level: str, masks: tuple[str, ...]) -> str:
    """The regular expression of the values that have one of the masks at a step: testing a value against it is the same
    as making its mask and looking it up, and costs a fraction."""

    def one(m: str) -> str:
        split = max(0, len(m) - 2) if level == "tail" else len(m)
        signs = [_SIGNS.get(c) for c in m[:split]]
        return "".join((x + ("+" if level == "runs" else "")) if x else re.escape(c) for x, c in zip(signs, m)) + re.escape(m[split:])

    return rf"\A(?:{'|'.join(map(one, masks))})\z"


def _rare(df: DataFrame, column: str, pattern: Pattern, declared: bool) -> Column:
    """Whether a value's mask is not among the accepted ones. With a declared form, masks that some bad value shares
    are not accepted either, and without any pattern every value is looked at."""
    if pattern.level == "none":
        return F.lit(declared)
    masks = pattern.masks if declared else (*pattern.masks, *pattern.broken)
    if not masks:
        return F.lit(True)
    return ~(q(column).rlike(mask_pattern(pattern.level, masks)) if _is_text(df, column) else level_mask(df, column, pattern.level).isin(*masks))


def violations(df: DataFrame, row_id: str, patterns: dict[str, Pattern], declared: dict[str, str] | None = None, ranges: dict[str, tuple[str, str]] | None = None, group: str | None = None) -> DataFrame:
    """One row a single bad value: ``finding``, ``column_name``, ``load_id`` (0 without ``group``), ``row_id``, ``mask``.

    ``pattern``: the value's mask is not among its column's mined ones; where a form is declared, values that keep it
    are let go. ``range``: a value that keeps its form but lies outside the range given. Nulls are no violation.
    """
    declared, ranges = declared or {}, ranges or {}
    kept = [q(c) for c in dict.fromkeys([row_id, *([group] if group else []), *patterns])]
    flags, found = {}, []
    for k, (c, p) in enumerate(patterns.items()):
        there = q(c).isNotNull()
        rare = _rare(df, c, p, c in declared)
        if c in declared:
            rare = rare & ~_conforms(q(c), declared[c])
        flags[f"__p{k}"] = F.coalesce(there & rare, F.lit(False))
        shown = level_mask(df, c, "class" if p.level == "none" else p.level)
        cell = lambda f, c=c, shown=shown: F.struct(F.lit(f).alias("finding"), F.lit(c).alias("column_name"), shown.alias("mask"))
        found.append(F.when(F.col(f"__p{k}"), cell("pattern")))
        if c in ranges:
            low, high = ranges[c]
            well = _conforms(q(c), declared[c]) if c in declared else ~rare
            flags[f"__r{k}"] = F.coalesce(there & ((q(c) < low) | (q(c) > high)) & well, F.lit(False))
            found.append(F.when(F.col(f"__r{k}"), cell("range")))
    g = (F.coalesce(q(group), F.lit(0)) if group else F.lit(0)).cast("int").alias("load_id")
    # rows without a finding, nearly all, go before anything is built of them
    met = df.select(*kept).withColumns(flags).where(reduce(lambda a, b: a | b, map(F.col, flags), F.lit(False)))
    return met.select(g, q(row_id).cast("long").alias("row_id"), F.inline(F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<finding: string, column_name: string, mask: string>>")))


def rare_masks(counts: DataFrame, patterns: dict[str, Pattern]) -> DataFrame:
    """(``column_name``, ``level``, ``mask``, ``n``): the masks that are not dominant in a column with a pattern."""
    parts = []
    for c, p in patterns.items():
        if p.level != "none":
            own = counts.where((F.col("column_name") == c) & F.col("mask").isNotNull())
            per = own.groupBy("column_name", F.lit(p.level).alias("level"), _at(p.level, F.col("mask"), F.col("tail")).alias("m")).agg(F.sum("n").alias("n"))
            parts.append(per.where(~F.col("m").isin(*p.masks, *p.broken)).withColumnRenamed("m", "mask"))
    return reduce(DataFrame.unionByName, parts) if parts else counts.limit(0).select("column_name", F.lit("").alias("level"), "mask", "n")


def _ranked(counts: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """The part of each interval that holds the wanted rank, as the next, narrower interval."""
    upto = F.sum("n").over(W.partitionBy(*keys, "rank").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    met = counts.join(picks.select(*keys, "rank", "inside"), keys).withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    inside = F.col("inside") - F.col("before")
    return met.where("before < inside and inside <= upto").select("grp", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), inside.alias("inside"), "n")


def group_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """(``grp``, ``median``) of the absolute values of ``value``; nulls and NaN don't count, of two middle values the mean is taken.

    Exact for any distribution, infinities included. The first pass counts by power of ten and two digits; each later
    one keeps the rows inside the chosen interval and counts them by ``PARTS`` equal parts of it. Parts follow the order
    of the values, so the next interval is the least and the greatest value of one part; at most ``PARTS`` counts a
    group are ranked at once. An interval is done when it is a single value or holds at most ``PARTS`` rows, which are
    sorted as one array; that takes five passes at most.
    """
    live = df.select(q(group).alias("grp"), F.abs(q(value).cast("double")).alias("v")).where("grp is not null and v is not null and not isnan(v)")
    power = F.greatest(F.floor(F.log10("v")), F.lit(-300)).cast("int")
    lead = power * 1000 + F.floor(F.col("v") / F.pow(F.lit(10.0), power) * 10).cast("int")
    k = F.when(F.col("v") == 0, F.lit(-1_000_000)).when(F.col("v") == float("inf"), F.lit(1_000_000)).otherwise(lead)
    stats = [F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")]
    counts = cut(live.groupBy("grp", k.alias("k")).agg(*stats))
    middle = F.explode(F.array_distinct(F.array(F.expr("(total + 1) div 2"), F.expr("total div 2 + 1"))))
    wanted = counts.groupBy("grp").agg(F.sum("n").alias("total")).select("grp", middle.alias("rank")).withColumn("inside", F.col("rank"))
    picks = cut(_ranked(counts, wanted, ["grp"]))
    done = [picks.where("lo = hi").select("grp", "rank", "lo")]
    picks = picks.where("lo < hi")
    while picks.limit(1).count():
        picks = picks.withColumn("few", F.col("n") <= PARTS)
        ranges = picks.select("grp", "lo", "hi", "few").distinct()
        near = small(cut(ranges.select(F.col("grp").alias("g"), "lo", "hi", "few")))
        live = cut(live.select("grp", "v").join(near, F.expr("grp = g and v between lo and hi")).select("grp", "v", "lo", "hi", "few"))
        sorted_ = live.where("few").groupBy("grp", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        done.append(picks.where("few").join(sorted_, ["grp", "lo", "hi"]).select("grp", "rank", F.expr("element_at(vs, int(inside))").alias("lo")))
        picks, live = picks.where("not few"), live.where("not few")
        if not picks.limit(1).count():
            break
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1)).cast("int")
        counts = live.groupBy("grp", "lo", "hi", part.alias("k")).agg(*stats)
        picks = cut(_ranked(counts, picks, ["grp", "lo", "hi"]))
        done.append(picks.where("lo = hi").select("grp", "rank", "lo"))
        picks = picks.where("lo < hi")
    return reduce(DataFrame.unionByName, done).groupBy("grp").agg(F.avg("lo").alias("median"))


def previous_loads(log: DataFrame, load: str = "load_id", feed: str = "feed_code", order: str = "load_seq") -> DataFrame:
    """(``grp``, ``prev``): each load and the one before it in its feed."""
    return log.select(F.col(load).alias("grp"), F.lag(load).over(W.partitionBy(feed).orderBy(order)).alias("prev")).where("prev is not null")


def _with_previous(stats: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    old = stats.select(F.col("grp").alias("prev"), *keys, *[F.col(c).alias(f"old_{c}") for c in stats.columns if c not in ("grp", *keys)])
    return stats.join(small(before), "grp").join(old, ["prev", *keys])


def divergence(counts: DataFrame, before: DataFrame, nulls: bool = True) -> DataFrame:
    """(``load_id``, ``column_name``, ``divergence``): Jensen-Shannon divergence (0 to 1) of a load's masks, with their
    tails, from the load before; null is a mask of its own or, without ``nulls``, does not count."""
    counts = counts if nulls else counts.where("mask is not null")
    one = counts.select("grp", "column_name", F.coalesce(_at("tail", F.col("mask"), F.col("tail")), F.lit("\u0000")).alias("m"), "n")
    per = one.groupBy("grp", "column_name", "m").agg(F.sum("n").alias("n"))
    whole = small(cut(one.groupBy("grp", "column_name").agg(F.sum("n").alias("of"))))
    p = per.join(whole, ["grp", "column_name"]).select("grp", "column_name", "m", (F.col("n") / F.col("of")).alias("p"))
    near = small(before)
    new = p.join(near.select("grp"), "grp").select("grp", "column_name", "m", "p", F.lit(0.0).alias("q"))
    old = p.withColumnRenamed("grp", "prev").join(near, "prev").select("grp", "column_name", "m", F.lit(0.0).alias("p"), F.col("p").alias("q"))
    both = new.unionByName(old).groupBy("grp", "column_name", "m").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    mid = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / mid)).otherwise(0.0) / 2
    found = both.groupBy(F.col("grp").alias("load_id"), "column_name").agg(F.sum(part("p") + part("q")).alias("divergence"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return found.where("p > 0 and q > 0").select("load_id", "column_name", "divergence")  # both loads have rows


def _least_divergence(step: float) -> float:
    """If the share of any one mask moves by ``step``, the divergence is at least this (Pinsker's inequality)."""
    return step * step / (2 * math.log(2)) * (1 - 1e-9)


def load_departures(counts: DataFrame, medians: dict[str, DataFrame], before: DataFrame, shares: dict[str, str], null_step: float = 0.10, share_step: float = 0.20, factor: float = 10.0) -> DataFrame:
    """(``finding``, ``column_name``, ``load_id``): loads that depart from the load before them.

    Loads whose masks diverge so little that no share can have moved by the step asked for are out at once; of the rest,
    ``null_share``: a column's share of nulls moved by ``null_step`` or more; ``mix``: the share, among non-null values,
    of the value given in ``shares`` (of at most two characters, so that its tail is the value) moved by ``share_step``;
    ``median``: the median is ``factor`` times the earlier one or more, or the ``factor``-th part or less. Loads without
    rows, and those after them, are not compared.
    """
    told = lambda own, step, nulls: divergence(own, before, nulls).where(F.col("divergence") >= _least_divergence(step)).select(F.col("load_id").alias("grp"), "column_name")
    per = counts.groupBy("grp", "column_name").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("mask").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
    moved = F.round(F.abs(F.col("nulls") / F.col("n") - F.col("old_nulls") / F.col("old_n")), 9)
    departed = _with_previous(per, before, ["column_name"]).join(told(counts, null_step, True), ["grp", "column_name"], "left_semi")
    found = departed.where(moved >= null_step).select(F.lit("null_share").alias("finding"), "column_name", F.col("grp").alias("load_id"))
    for c, value in shares.items():
        if len(value) > 2:
            raise ValueError("the value whose share is watched has at most two characters")
        own = counts.where((F.col("column_name") == c) & F.col("mask").isNotNull())
        same = (F.col("tail") == value) & (F.length("mask") == len(value))
        own = own.groupBy("grp", "column_name").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("k"))
        moved = F.round(F.abs(F.col("k") / F.col("n") - F.col("old_k") / F.col("old_n")), 9)
        departed = _with_previous(own, before, ["column_name"]).join(told(counts.where(F.col("column_name") == c), share_step, False), ["grp", "column_name"], "left_semi")
        found = found.unionByName(departed.where(moved >= share_step).select(F.lit("mix").alias("finding"), "column_name", F.col("grp").alias("load_id")))
    for c, med in medians.items():
        new, old = F.col("median"), F.col("old_median")
        far = ((new >= old * factor) | (new <= old / factor)) & (new != old)
        found = found.unionByName(_with_previous(med, before, []).where(far).select(F.lit("median").alias("finding"), F.lit(c).alias("column_name"), F.col("grp").alias("load_id")))
    return found


def distinct_counts(df: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """(``grp``, ``column_name``, ``n_distinct``): the exact number of different non-null values, by group.

    Two stages a column, so no task holds the values of a group.
    """
    g = q(group) if group else F.lit(0)
    values = [df.select(g.alias("grp"), q(c).alias("value")).where("value is not null").distinct().groupBy("grp").agg(F.count("*").alias("n_distinct")) for c in columns]
    return reduce(DataFrame.unionByName, [v.select("grp", F.lit(c).alias("column_name"), "n_distinct") for c, v in zip(columns, values)])


def profile(df: DataFrame, columns: list[str] | None = None, group: str | None = None) -> DataFrame:
    """One row a column, and a group if one is given: rows, nulls, null rate, exact number of distinct values, least and
    greatest value as text, the step of its masks, their number, the dominant masks and the rows with a rare one.

    With ``group`` the result has ``grp`` (null is a group too). Masks are dominant or not in the whole column, so a
    group of nothing but malformed values shows them as rare; ``dominant_masks`` has those that the group holds.
    """
    columns = [c for c in df.columns if c != group] if columns is None else columns
    aggs = []
    for k, c in enumerate(columns):
        x = q(c)
        aggs += [F.count(x).alias(f"n{k}"), plain_text(df.schema[c].dataType, F.min(x)).alias(f"lo{k}"), plain_text(df.schema[c].dataType, F.max(x)).alias(f"hi{k}")]
    aggs = [F.count("*").alias("rows"), *aggs]
    one = df.groupBy(q(group).alias("grp")).agg(*aggs) if group else df.agg(*aggs).withColumn("grp", F.lit(0))
    cells = [F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("n_rows"), (F.col("rows") - F.col(f"n{k}")).alias("n_nulls"), F.col(f"lo{k}").alias("least"), F.col(f"hi{k}").alias("greatest")) for k, c in enumerate(columns)]
    stats = one.select("grp", F.inline(F.array(*cells)))
    counts = cut(mask_counts(df, group, columns))
    patterns = mine(counts)
    own = []
    for c, p in patterns.items():
        level = "runs" if p.level == "none" else p.level
        per = counts.where((F.col("column_name") == c) & F.col("mask").isNotNull()).groupBy("grp", "column_name", _at(level, F.col("mask"), F.col("tail")).alias("m")).agg(F.sum("n").alias("n"))
        top = F.col("m").isin(*p.masks) if p.masks else F.lit(False)
        rare = F.lit(0).cast("long") if p.level == "none" else F.sum(F.when(top, 0).otherwise(F.col("n")))
        own.append(per.groupBy("grp", "column_name").agg(F.lit(p.level).alias("level"), F.count("*").alias("n_masks"), F.array_sort(F.collect_list(F.when(top, F.col("m")))).alias("dominant_masks"), rare.alias("rare_rows")))
    # united and folded, not joined: a null group meets itself
    parts = reduce(lambda a, b: a.unionByName(b, True), [stats, distinct_counts(df, columns, group), *own])
    names = ["n_rows", "n_nulls", "n_distinct", "least", "greatest", "level", "n_masks", "dominant_masks", "rare_rows"]
    if not own:
        parts = parts.withColumns({"level": F.lit(None).cast("string"), "n_masks": F.lit(None).cast("long"), "dominant_masks": F.lit(None).cast("array<string>"), "rare_rows": F.lit(None).cast("long")})
    whole = parts.groupBy("grp", "column_name").agg(*[F.max(c).alias(c) for c in names])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.select(
        *(["grp"] if group else []), "column_name", "n_rows", "n_nulls", F.try_divide("n_nulls", "n_rows").alias("null_rate"), zero("n_distinct"), "least", "greatest", F.coalesce("level", F.lit("none")).alias("level"), zero("n_masks"),
        F.when(F.size("dominant_masks") > 0, F.col("dominant_masks")).alias("dominant_masks"), zero("rare_rows"),
    )
