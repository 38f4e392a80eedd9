"""Reading and writing tables by file suffix, SQL over Parquet paths, and replacing a stored table safely."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ruleframe.errors import RuleError
from ruleframe.functions.columns import q, require
from ruleframe.sources.xlsx import read_xlsx, write_xlsx


def _suffix(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """``.xlsx`` and ``.xlsm`` sheets, ``.parquet`` files and directories; Parquet takes no sheet name."""
    if _suffix(path) in (".xlsx", ".xlsm"):
        return read_xlsx(spark, local(spark, path), sheet)
    if _suffix(path) == ".parquet":
        if sheet is not None:
            raise RuleError("Parquet has no sheets")
        return spark.read.parquet(path)
    raise RuleError(f"cannot read {path!r}: only .xlsx, .xlsm and .parquet")


def _paths(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path``, as the path's own file system knows it (``file:``, ``hdfs:``, ``s3a:``, ...)."""
    fs, p, _ = _paths(spark, path)
    return fs.exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system and folder: one name for one place, however it is written."""
    fs, p, _ = _paths(spark, path)
    return fs.makeQualified(p).toString()


def local(spark: SparkSession, path: str) -> str:
    """The path of a sheet as the driver's own file system knows it; sheets are single files beside the driver."""
    scheme = re.match(r"(\w+):", path)
    if scheme and scheme.group(1).lower() != "file" and len(scheme.group(1)) > 1:
        raise RuleError(f"sheets are read and written as local files, not at {path!r}")
    return _paths(spark, path)[1].toUri().getPath() if scheme else path


def write_table(df: DataFrame, path: str, sheet: str | None = None, captions: dict[str, str] | None = None, verify: Callable[[], None] | None = None, progress: Callable[[int, int | None], None] | None = None) -> str:
    """Write a table over what is there and return the path.

    Parquet goes to a staging directory beside it first; ``verify`` runs when that is written, and only then the
    directory takes the place of the old one. So a table may be written over one of its own inputs. ``progress`` is
    told how many rows of a sheet are written.
    """
    if _suffix(path) == ".xlsx":
        path = local(df.sparkSession, path)
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        staged = os.path.join(os.path.dirname(os.path.abspath(path)), f".{uuid.uuid4().hex}.xlsx")
        try:
            write_xlsx(df, staged, sheet or "Sheet1", captions, progress)
            if verify:
                verify()
            shutil.move(staged, path)
        finally:
            if os.path.exists(staged):
                os.remove(staged)
        return path
    if _suffix(path) != ".parquet":
        raise RuleError(f"cannot write {path!r}: only .xlsx and .parquet")
    fs, target, make = _paths(df.sparkSession, path)
    staging = make(target.getParent() or make("."), f".staging-{uuid.uuid4().hex}")
    old = make(target.getParent() or make("."), f".old-{uuid.uuid4().hex}")
    try:
        df.write.mode("overwrite").parquet(staging.toString())
        if verify:
            verify()
        if fs.exists(target):
            fs.rename(target, old)
        if not fs.rename(staging, target):
            if fs.exists(old):
                fs.rename(old, target)
            raise RuleError(f"{path} could not be put in place")
    finally:
        fs.delete(staging, True)
        if fs.exists(target):
            fs.delete(old, True)
    return path


_CALL = re.compile(r"(?i)\bread_parquet\s*\(\s*'((?:[^']|'')+)'\s*\)")


def query(spark: SparkSession, sql: str) -> DataFrame:
    """Spark SQL in which ``read_parquet('path')`` may stand for a table; quoted text elsewhere stays as it is."""
    if not sql or not sql.strip():
        raise RuleError("the SQL text is blank")
    out, at = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|read_parquet\s*\(\s*'(?:[^']|'')+'\s*\)", sql, re.I):
        if call := _CALL.fullmatch(m.group()):
            path = call.group(1).replace("''", "'").replace("`", "``")
            out += [sql[at : m.start()], f"parquet.`{path}`"]
            at = m.end()
    return spark.sql("".join(out) + sql[at:])


def captions(config: DataFrame, standard: str = "standard", comments: str = "comments") -> dict[str, str]:
    """The caption of each field in a small caption table."""
    require(config, [standard, comments], "caption table")
    return {r[0]: r[1] for r in config.select(q(standard).cast("string"), q(comments).cast("string")).collect() if r[0] is not None and r[1] is not None}
