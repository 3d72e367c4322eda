"""Dates, booleans and smaller number types."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.selectors import FLOATS, INTEGERS, chosen, col, dates, numeric, replaced, strings
from millrace.functions.stats import first_row
from millrace.functions.text import trim
from millrace.functions.words import FALSE_WORDS, TRUE_WORDS

#: Formats that are tried, in order; the first with enough success wins.
DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss"]
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyyMMdd", "dd.MM.yyyy", "d MMM yyyy", "MMM d, yyyy"]


@F.pandas_udf(T.TimestampNTZType())
def _guessed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    from dateutil import parser

    def parse(s: str | None):
        try:
            return parser.parse(s).replace(tzinfo=None) if s else None
        except (ValueError, OverflowError, TypeError):
            return None

    for part in parts:
        yield pd.Series(pd.to_datetime([parse(s) for s in part], errors="coerce"))


def _outline(pattern: str) -> str:
    """A regular expression that every value of a date format matches: digits or a name for each field, its separators between."""
    field = lambda m: ".+" if "MMM" in m[0] else r"[+\-]?\d+"
    parts = [re.escape(p) if k % 2 else re.sub("[A-Za-z]+", field, re.escape(p)) for k, p in enumerate(pattern.split("'"))]  # quoted text stands for itself
    return "^" + "".join(parts) + "$"


def parse_dates(df: DataFrame, columns: Iterable[str] | None = None, min_success: float = 0.7) -> DataFrame:
    """String columns as timestamps or dates where a known format fits ``min_success`` of the non-null values.

    All formats of all columns are counted in one aggregation; only columns that no format fits are tried value by value
    with a general parser. A column without values stays as it is.
    """
    names = [c for c in chosen(df, columns, strings(df)) if c in strings(df)]
    tries: dict[tuple[str, str], Column] = {}
    for c in names:
        for formats, kind in ((DATETIME_FORMATS, "timestamp_ntz"), (DATE_FORMATS, "date")):
            for f in formats:  # a failed parse is dear: only values of the format's outline are tried
                tries[(c, f)] = F.when(col(c).rlike(_outline(f)), F.try_to_timestamp(col(c), F.lit(f)).cast(kind))
    got = first_row(df, {k: F.count(e) for k, e in tries.items()} | {c: F.count(col(c)) for c in names})
    new = {}
    for c in names:
        fits = [f for f in [*DATETIME_FORMATS, *DATE_FORMATS] if got[c] and got[(c, f)] / got[c] >= min_success]
        if fits:
            new[c] = tries[(c, fits[0])]
    rest = [c for c in names if c not in new and got[c]]
    if rest:
        guessed = first_row(df.select(*[_guessed(col(c)).alias(f"g{i}") for i, c in enumerate(rest)]), {c: F.count(f"g{i}") for i, c in enumerate(rest)})
        new |= {c: _guessed(col(c)) for c in rest if guessed[c] / got[c] >= min_success}
    return replaced(df, new)


def extract_date_parts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``_year``, ``_month``, ``_day``, ``_weekday`` (Monday is 1) and ``_quarter`` of date columns."""
    new: dict[str, Column] = {}
    for c in chosen(df, columns, dates(df)):
        x = col(c)
        new |= {f"{c}_year": F.year(x), f"{c}_month": F.month(x), f"{c}_day": F.day(x), f"{c}_weekday": F.weekday(x) + 1, f"{c}_quarter": F.quarter(x)}
    return replaced(df, new)


def normalize_booleans(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Columns of words for true and false as booleans; without ``columns``, those string columns that hold nothing else."""
    word = lambda c: F.lower(trim(col(c).cast("string")))
    names = chosen(df, columns, strings(df))
    if columns is None:
        got = first_row(df, {c: F.bool_and(word(c).isin(*TRUE_WORDS, *FALSE_WORDS)) for c in names})
        names = [c for c in names if got[c]]
    return replaced(df, {c: F.when(word(c).isin(*TRUE_WORDS), True).when(word(c).isin(*FALSE_WORDS), False) for c in names})


def downcast_numeric(df: DataFrame) -> DataFrame:
    """Integers in the smallest type that holds their range, doubles as floats."""
    whole = [c for c in numeric(df) if isinstance(df.schema[c].dataType, INTEGERS)]
    got = first_row(df, {("lo", c): F.min(col(c)) for c in whole} | {("hi", c): F.max(col(c)) for c in whole})
    new = {c: col(c).cast("float") for c in numeric(df) if isinstance(df.schema[c].dataType, FLOATS)}
    for c in whole:
        lo, hi = got[("lo", c)], got[("hi", c)]
        kind = next((k for k, bits in (("byte", 7), ("short", 15), ("int", 31)) if lo is None or -(1 << bits) <= lo and hi < 1 << bits), "long")
        new[c] = col(c).cast(kind)
    return replaced(df, new)
