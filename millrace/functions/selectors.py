"""Which columns a step touches, by physical type."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _of(df: DataFrame, kinds: tuple) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def core_numeric(df: DataFrame) -> list[str]:
    """64-bit numbers only: the columns of the core statistics (outliers, skewness, correlation, KNN)."""
    return _of(df, (T.DoubleType, T.LongType))


def signed_numeric(df: DataFrame) -> list[str]:
    """32- and 64-bit numbers: the columns of the negative-value step and of numeric targets."""
    return _of(df, (T.DoubleType, T.LongType, T.IntegerType, T.FloatType))


def numeric(df: DataFrame) -> list[str]:
    """All integers and floats; decimals are never touched."""
    return _of(df, FLOATS + INTEGERS)


def strings(df: DataFrame) -> list[str]:
    return _of(df, (T.StringType,))


def dates(df: DataFrame) -> list[str]:
    return _of(df, DATES)


def chosen(df: DataFrame, columns: Iterable[str] | None, default: list[str]) -> list[str]:
    """The given columns that exist, in the given order, or the default ones."""
    return default if columns is None else [c for c in columns if c in df.columns]


def col(name: str) -> Column:
    """A column by its literal name (dots and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, so that statistics ignore both."""
    return F.nanvl(col(name), F.lit(None).cast(df.schema[name].dataType)) if isinstance(df.schema[name].dataType, FLOATS) else col(name)


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with columns replaced in place and others added at the end: one projection."""
    return df.select(*[(new[c] if c in new else col(c)).alias(c) for c in df.columns], *[e.alias(c) for c, e in new.items() if c not in df.columns])
