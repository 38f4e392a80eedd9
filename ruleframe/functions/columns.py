"""Column helpers with the null and blank rules the operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleframe.errors import RuleError

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def q(name: str) -> Column:
    """The column of that name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, names: Iterable[str], what: str = "input") -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise RuleError(f"{what} lacks the columns {missing}")


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(kind(df, name), (T.StringType, T.CharType, T.VarcharType))


def blank(c: Column) -> Column:
    """Null, empty or white space only; for text columns."""
    return c.isNull() | c.rlike(r"^\s*$")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def number(df: DataFrame, name: str) -> Column:
    """The column as double; null for null, blank and text that is no number."""
    c = q(name)
    return F.when(c.rlike(_NUMBER), strip(c).try_cast("double")) if is_text(df, name) else c.try_cast("double")


def amount(df: DataFrame, name: str) -> Column:
    """An amount: null and blank are 0; NaN, infinities and text that is no number stop the query when it runs."""
    if not is_text(df, name) and not isinstance(kind(df, name), (*NUMERIC, T.NullType)):
        raise RuleError(f"column {name} is no number")
    c, x = q(name), number(df, name)
    empty = blank(c) if is_text(df, name) else c.isNull()
    bad = ~empty & (x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"column {name} holds no finite number: "), c.cast("string"))).cast("double")).otherwise(F.coalesce(x, F.lit(0.0)))


def plain_text(kind_: T.DataType, c: Column) -> Column:
    """A value as text, written alike by any engine: numbers with six decimals (as Spark writes them where they are too
    large for that), times to the microsecond."""
    if isinstance(kind_, (T.DoubleType, T.FloatType)):
        return F.coalesce(c.try_cast("decimal(38,6)").cast("string"), c.cast("string"))
    if isinstance(kind_, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c.cast("string")


def amounts(df: DataFrame, names: Iterable[str]) -> DataFrame:
    names = list(names)
    require(df, names)
    return df.withColumns({n: amount(df, n) for n in names}) if names else df

