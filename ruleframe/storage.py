"""Where intermediate results live: reliable checkpoints in the folder all executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; it is used as it stands. Only where neither that setting nor a
    folder set by the caller exists (tests, local runs) is one made, and never on a cluster's local disk.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if configured is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # one process; local-cluster has several
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), f"ruleframe-{context.applicationId}")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        configured = f"file://{own}"
    context.setCheckpointDir(configured)
    return configured


def workspace(spark: SparkSession) -> str:
    """A folder of its own under the checkpoint folder, for tables that are written and read by name."""
    return f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[str], id_column: str = "id") -> DataFrame:
    """``df`` sorted over the whole cluster by ``order``, with its position in that order (0, 1, ...) as ``id_column``.

    The sort is a range exchange; the driver sees one row count per partition.
    """
    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    place = F.monotonically_increasing_id()
    placed = ordered.withColumn("__part", F.shiftright(place, 33).cast("int")).withColumn(
        "__at", place.bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    start, starts = 0, []
    for part in range(max(sizes, default=-1) + 1):
        starts.append(start)
        start += sizes.get(part, 0)
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts or [0]]), F.col("__part") + 1)
    return placed.withColumn(id_column, offset + F.col("__at")).drop("__part", "__at")
