"""References to records that do not exist, or not at the time of the reference.

References are pre-aggregated by key and month, with the earliest and the latest time of use. Most groups are settled
there: the key is unknown, or one stretch of its validity covers all its uses. Only groups left over go back to their
rows. Keys that hold a thousandth of all references or more (at most a thousand keys) are checked against a broadcast of
these keys, each with its validity and the months left over, or, if that is too large to send, by an exchange in which
their rows are salted. All other keys go through exchange joins on the key, whose groups are then bounded. Both halves are
united at the end. Where all groups left over are few, one pass over the rows with a broadcast of them does for both.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleframe.operators.sizes import BROADCAST_ROWS, heavy_keys
from ruleframe.storage import cut

KEY = ["d", "c"]
GROUP = ["table_name", "d", "c", "month"]
#: Parts into which a heavy key's rows are cut where its validity is too large to broadcast.
SALTS = 64


def references(table_name: str, rows: DataFrame, row_id: str, code: str, at: str, dimension: str | Column) -> DataFrame:
    """One row a non-blank reference. ``dimension``: a column of ``rows``, or a constant as ``F.lit``."""
    d = F.col(dimension) if isinstance(dimension, str) else dimension
    return rows.where(F.col(code).isNotNull() & ~F.col(code).rlike(r"^\s*$")).select(
        F.lit(table_name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), d.alias("d"), F.col(code).alias("c"), F.col(at).alias("t")
    )


_MERGE = """aggregate(array_sort(x), cast(array() as array<struct<s: timestamp_ntz, e: timestamp_ntz>>), (done, v) ->
  case when size(done) = 0 or done[size(done) - 1].e < v.s then concat(done, array(v))
       else concat(slice(done, 1, size(done) - 1), array(struct(done[size(done) - 1].s as s, greatest(done[size(done) - 1].e, v.e) as e))) end)"""


def validity(members: DataFrame, dimension: str, code: str, start: str, end: str) -> DataFrame:
    """Each member with ``valid``, its stretches of validity merged where they touch, and ``first``, its first start.

    Merged by day of start, then by month, then altogether, so a member registered over and over stays small.
    """
    never = F.lit("9999-12-31").cast("timestamp_ntz")
    s, e = F.col(start).cast("timestamp_ntz"), F.coalesce(F.col(end).cast("timestamp_ntz"), never)
    rows = members.select(F.col(dimension).alias("d"), F.col(code).alias("c"), s.alias("s"), e.alias("e")).where("d is not null and c is not null")
    one = rows.groupBy("d", "c", "s").agg(F.max("e").alias("e"))
    span = F.when(F.col("s") < F.col("e"), F.struct("s", "e"))
    day = one.groupBy("d", "c", F.date_trunc("day", "s").alias("day")).agg(F.min("s").alias("first"), F.collect_list(span).alias("x"))
    month = day.select("d", "c", "first", F.date_trunc("month", "day").alias("month"), F.expr(_MERGE).alias("x"))
    month = month.groupBy("d", "c", "month").agg(F.min("first").alias("first"), F.flatten(F.collect_list("x")).alias("x"))
    whole = month.select("d", "c", "first", F.expr(_MERGE).alias("x")).groupBy("d", "c").agg(F.min("first").alias("first"), F.flatten(F.collect_list("x")).alias("x"))
    return whole.select("d", "c", "first", F.expr(_MERGE).alias("valid"), F.lit(True).alias("known"))


@dataclass(frozen=True)
class Orphans:
    rows: DataFrame
    """``table_name``, ``row_id``, ``reason``, ``ref_month``: one row an orphan reference."""
    counts: DataFrame
    """``table_name``, ``ref_month``, ``reason``, ``n_orphans``, without the months that have none."""


def _judged(met: DataFrame) -> DataFrame:
    """The orphans among rows that carry what is known of their key."""
    fine = F.exists("valid", lambda v: (v["s"] <= F.col("t")) & (v["e"] > F.col("t")))
    reason = F.when(F.col("known").isNull(), "missing").when(F.coalesce(F.col("first") > F.col("t"), F.lit(True)), "late").otherwise("deleted")
    return met.where(F.col("known").isNull() | ~F.coalesce(fine, F.col("t").isNull())).select("table_name", "row_id", reason.alias("reason"), F.col("month").alias("ref_month"))


def find(members: DataFrame, refs: list[DataFrame], dimension: str = "dimension", code: str = "element_code", start: str = "created_at", end: str = "deleted_at", limit: int = BROADCAST_ROWS) -> Orphans:
    """The references without a member valid at their time.

    ``reason`` is ``missing`` (no such member), ``late`` (all its rows start later) or ``deleted``. A null dimension is
    a member nobody has: ``missing``. A reference without a time is an orphan only if the member is missing, with ''
    for its month. A member row without a start is never valid and counts as starting late. Empty inputs give none.
    ``limit``: frames of so many groups and stretches of validity together are broadcast.
    """
    every = reduce(DataFrame.unionByName, refs).withColumn("t", F.col("t").cast("timestamp_ntz"))
    every = every.withColumn("month", F.coalesce(F.date_format("t", "yyyyMM"), F.lit("")))
    nowhere = every.where("d is null").select("table_name", "row_id", F.lit("missing").alias("reason"), F.col("month").alias("ref_month"))
    every = every.where("d is not null")
    grouped = cut(every.groupBy(*GROUP).agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")))
    heavy = cut(heavy_keys(grouped, KEY, "n"))
    valid = cut(validity(members, dimension, code, start, end))
    hot = F.broadcast(heavy)
    unsettled = (F.col("known").isNull()) | ~F.coalesce(F.exists("valid", lambda v: (v["s"] <= F.col("lo")) & (v["e"] > F.col("hi"))), F.col("lo").isNull())

    def suspects(groups: DataFrame, lookup: DataFrame) -> DataFrame:
        return groups.join(lookup, KEY, "left").where(unsettled).select(*GROUP, "known", "first", "valid")

    own = cut(valid.join(hot, KEY, "left_semi"))
    hot_suspects = suspects(grouped.join(hot, KEY, "left_semi"), F.broadcast(own) if _fits(own, limit) else own)
    left = cut(hot_suspects.withColumn("hot", F.lit(True)).unionByName(suspects(grouped.join(hot, KEY, "left_anti"), valid).withColumn("hot", F.lit(False))))
    if _fits(left, limit):
        found = [_judged(every.join(F.broadcast(left.drop("hot")), GROUP))]
    else:
        # one row a heavy key: its validity, and its months left over in each table
        kept = left.where("hot").groupBy(*KEY).agg(F.collect_list(F.struct("table_name", "month")).alias("open")).join(own, KEY, "left")
        kept = cut(kept)
        rows = every.join(hot, KEY, "left_semi")
        if _fits(kept, limit):
            met = rows.join(F.broadcast(kept), KEY)
        else:
            met = rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS))).join(kept.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))), [*KEY, "salt"])
        there = F.struct(F.col("table_name"), F.col("month"))
        found = [_judged(met.where(F.array_contains("open", there))), _judged(every.join(hot, KEY, "left_anti").join(left.where("not hot").drop("hot"), GROUP))]
    found.append(nowhere)
    counts = [x.groupBy("table_name", "ref_month", "reason").agg(F.count("*").alias("n")) for x in found]
    return Orphans(
        reduce(DataFrame.unionByName, found),
        reduce(DataFrame.unionByName, counts).groupBy("table_name", "ref_month", "reason").agg(F.sum("n").alias("n_orphans")),
    )


def _fits(df: DataFrame, limit: int) -> bool:
    """Whether rows and the elements of their arrays together are few enough to be broadcast."""
    arrays = [F.coalesce(F.size(c), F.lit(0)) for c, kind in df.dtypes if kind.startswith("array")]
    weight = F.lit(1) + reduce(lambda a, b: a + b, [F.greatest(x, F.lit(0)) for x in arrays], F.lit(0))
    return (df.agg(F.sum(weight)).first()[0] or 0) <= limit
