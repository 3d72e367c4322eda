"""Cleaning of string values: one projection a step."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text
from millrace.functions.selectors import chosen, col, present, replaced, signed_numeric, strings
from millrace.functions.stats import first_row

GATE = r"[$,₹-]"


def _each(df: DataFrame, columns: Iterable[str] | None, f) -> DataFrame:
    return replaced(df, {c: f(col(c).cast("string")) for c in chosen(df, columns, strings(df))})


def normalize_whitespace(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return _each(df, columns, text.normalize_whitespace)


@F.pandas_udf(T.StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def normalize_unicode(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NFKC, then without control characters. ASCII values are in that form already, so only the others leave the JVM."""
    names = chosen(df, columns, strings(df))
    return replaced(df, {c: text.drop_control(F.when(col(c).cast("string").rlike(r"^\p{ASCII}*$"), col(c).cast("string")).otherwise(_nfkc(F.when(~col(c).cast("string").rlike(r"^\p{ASCII}*$"), col(c).cast("string"))))) for c in names})


def fix_mojibake(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return _each(df, columns, text.fix_mojibake)


def standardize_casing(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns in ``title``, ``lower`` or ``upper`` case by ``mapping``; any other mode only makes them strings."""
    modes = {"title": text.title, "lower": F.lower, "upper": F.upper}
    return replaced(df, {c: modes.get(m, lambda x: x)(col(c).cast("string")) for c, m in mapping.items() if c in df.columns})


def standardize_categories(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return _each(df, columns, lambda x: F.lower(text.normalize_whitespace(x)))


def _gated(df: DataFrame, names: list[str]) -> list[str]:
    """The columns with a value that holds one of the symbols."""
    got = first_row(df, {c: F.max(col(c).cast("string").rlike(GATE).cast("int")) for c in names})
    return [c for c in names if got[c]]


def replace_symbols(df: DataFrame) -> DataFrame:
    """Columns that hold ``$ , ₹`` or ``-`` become strings without these and without bullets."""
    simple = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary", "variant"))]
    return replaced(df, {c: text.strip_symbols(col(c).cast("string")) for c in _gated(df, simple)})


def replace_symbols_and_convert_to_float(df: DataFrame, min_success: float = 0.7, strict_compat: bool = False) -> DataFrame:
    """String columns that hold symbols, as doubles.

    A column is converted if ``min_success`` of its non-null values are numbers once the symbols are gone, and a leading
    minus stays. ``strict_compat``: every such column is converted, minus signs are dropped, other values become null.
    """
    names = _gated(df, strings(df))
    sign = lambda x: F.when(text.trim(x).rlike(r"^[$₹]*-"), F.lit("-")).otherwise(F.lit(""))
    bare = lambda x: F.translate(x, "$,₹-", "")
    value = lambda c: text.number(bare(col(c))) if strict_compat else text.number(F.concat(sign(col(c)), text.trim(F.translate(F.regexp_replace(text.trim(col(c)), r"^[$₹]*-", ""), "$,₹", ""))))
    if not strict_compat:
        got = first_row(df, {(k, c): F.count(e) for c in names for k, e in (("all", col(c)), ("ok", value(c)))})
        names = [c for c in names if got[("all", c)] and got[("ok", c)] / got[("all", c)] >= min_success]
    return replaced(df, {c: value(c) for c in names})


def handle_negative_values(df: DataFrame) -> DataFrame:
    """Absolute values of all signed number columns: the same for columns without negatives, so nothing is counted first."""
    return replaced(df, {c: F.abs(col(c)) for c in signed_numeric(df)})


def negative_report(df: DataFrame) -> dict[str, bool]:
    """Which number columns hold a negative value."""
    return {c: bool(v) for c, v in first_row(df, {c: F.max((present(df, c) < 0).cast("int")) for c in signed_numeric(df)}).items()}
