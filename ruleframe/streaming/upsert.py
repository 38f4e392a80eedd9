"""Incremental partition replacement: each micro-batch replaces the partitions it brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ruleframe.errors import RuleError
from ruleframe.functions.columns import q


def replace_partitions_stream(stream: DataFrame, path: str, partition_by: list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream to partitioned Parquet; partitions that occur in a batch are overwritten as a whole.

    Running a batch again after a failure gives the same table. Partitions not in the batch are not touched.
    """
    if not partition_by:
        raise RuleError("name the partition columns")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row a key; nulls in ``order`` come before all else, of equal rows any one stays."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*map(q, keys)).agg(F.max_by(F.struct(*map(q, rest)), F.struct(*map(q, order))).alias("__last"))
    return last.select(*[F.col("__last").getField(c).alias(c) if c in rest else q(c) for c in df.columns])
