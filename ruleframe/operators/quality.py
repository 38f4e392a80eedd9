"""Checks of dimension metadata, and of data against it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleframe.functions.columns import blank, is_text, q, require
from ruleframe.operators.unify import union_relaxed

META = ["dimension", "element_code", "element_name", "is_base", "parent"]


def check_metadata(metadata: DataFrame) -> DataFrame:
    """(``dimension``, ``element_code``, ``reason``), one row a fault of a metadata row.

    ``duplicate``: the member occurs again; ``name blank``; ``flag blank``; ``flag not Y or N``; ``parent missing`` in
    the dimension; ``parent is base``: no row of the parent is a summary (``N``).
    """
    require(metadata, META, "metadata")
    key = ["dimension", "element_code"]
    per = metadata.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("is_base") == "N", F.lit(False))).alias("summary"))
    own = metadata.join(per.select(F.col("dimension").alias("d1"), F.col("element_code").alias("c1"), "n"), F.col("dimension").eqNullSafe(F.col("d1")) & F.col("element_code").eqNullSafe(F.col("c1")))
    up = own.join(per.select(F.col("dimension").alias("d2"), F.col("element_code").alias("c2"), "summary"), (F.col("dimension") == F.col("d2")) & (F.col("parent") == F.col("c2")), "left")
    has_parent = ~blank(F.col("parent"))
    faults = {
        "duplicate": F.col("n") > 1,
        "name blank": blank(F.col("element_name")),
        "flag blank": blank(F.col("is_base")),
        "flag not Y or N": ~blank(F.col("is_base")) & ~F.col("is_base").isin("Y", "N"),
        "parent missing": has_parent & F.col("c2").isNull(),
        "parent is base": has_parent & F.col("c2").isNotNull() & ~F.col("summary"),
    }
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in faults.items()]))
    return up.select(*key, F.explode(reasons).alias("reason"))


def check_members(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """The rows of ``df`` with ``CHECK_DIMENSION``, ``CHECK_ELEMENT_CODE``, ``REASON``, one row a violation.

    Every dimension of the metadata must be a column of ``df`` (else one row without data); its values must be base
    members. Blank values are faults; texts that begin with ``reg{`` or ``var{`` are rules and pass.
    """
    require(metadata, META, "metadata")
    dimensions = sorted(r[0] for r in metadata.where("dimension is not null").select("dimension").distinct().collect())
    base = metadata.where("is_base = 'Y'").select("dimension", "element_code").distinct()
    there = [d for d in dimensions if d in df.columns]
    marked = df
    for k, d in enumerate(there):
        codes = base.where(F.col("dimension") == d).select(F.col("element_code").alias(f"__b{k}"))
        # a number is never equal to a text code
        marked = marked.join(codes, q(d) == F.col(f"__b{k}"), "left") if is_text(df, d) else marked.withColumn(f"__b{k}", F.lit(None).cast("string"))
    cells = []
    for k, d in enumerate(there):
        text = q(d).cast("string")
        rule = F.coalesce(text.startswith("reg{") | text.startswith("var{"), F.lit(False))
        why = F.when(blank(text), "value is blank").when(~rule & F.col(f"__b{k}").isNull(), "not a base member")
        cells.append(F.when(why.isNotNull(), F.struct(F.lit(d).alias("CHECK_DIMENSION"), text.alias("CHECK_ELEMENT_CODE"), why.alias("REASON"))))
    parts = []
    if cells:
        parts.append(marked.select(*[q(c) for c in df.columns], F.inline(F.array_compact(F.array(*cells)))))
    for d in dimensions:
        if d not in there:
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
            parts.append(df.sparkSession.range(1).select(*none, F.lit(d).alias("CHECK_DIMENSION"), F.lit(None).cast("string").alias("CHECK_ELEMENT_CODE"), F.lit("the data have no such column").alias("REASON")))
    if not parts:
        return df.limit(0).select(*[q(c) for c in df.columns], *[F.lit("").alias(c) for c in ("CHECK_DIMENSION", "CHECK_ELEMENT_CODE", "REASON")])
    return reduce(lambda a, b: union_relaxed([a, b]), parts)
