"""Outliers, skewness and collinearity."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.selectors import chosen, col, core_numeric, numeric, present, replaced
from millrace.functions.stats import ACCURACY, correlations, first_row, iqr_fences, medians, quantiles, skewnesses
from millrace.functions.storage import fresh_names, small_side


def check_outliers(df: DataFrame) -> dict[str, DataFrame]:
    """For each 64-bit number column the rows strictly outside its fences (as a lazy table); columns without values are left out."""
    fences = iqr_fences(df, core_numeric(df))
    return {c: df.where((present(df, c) < f[0]) | (present(df, c) > f[1])) for c, f in fences.items() if f}


def remove_outliers(df: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Rows inside the fences of every 64-bit number column, taken one after another: each column's fences are those of the
    rows left so far. Rows without a value in such a column go; a column without any value is skipped (or, strictly,
    empties the table)."""
    for c in core_numeric(df):
        f = iqr_fences(df, [c])[c]
        if f:
            df = df.where(present(df, c).between(*f))
        elif strict_compat:
            df = df.where(F.lit(False))
    return df


def remove_outliers_zscore(df: DataFrame, threshold: float = 3.0, columns: Iterable[str] | None = None) -> DataFrame:
    for c in chosen(df, columns, numeric(df)):
        x = present(df, c)
        got = first_row(df, {"m": F.avg(x), "s": F.stddev_samp(x)})
        if got["s"]:
            df = df.where(F.abs((x - F.lit(got["m"])) / F.lit(got["s"])) <= threshold)
    return df


def remove_outliers_mad(df: DataFrame, threshold: float = 3.5, columns: Iterable[str] | None = None) -> DataFrame:
    for c in chosen(df, columns, numeric(df)):
        x = present(df, c)
        middle = medians(df, [c])[c]
        if middle is None:
            continue
        away = df.select(F.abs(x - F.lit(float(middle))).alias("d"))
        mad = medians(away, ["d"])["d"]
        if mad:
            df = df.where(F.abs(F.lit(0.6745) * (x - F.lit(float(middle))) / F.lit(mad)) <= threshold)
    return df


def winsorize(df: DataFrame, lower: float = 0.05, upper: float = 0.05, columns: Iterable[str] | None = None) -> DataFrame:
    """Values clipped to the nearest-rank quantiles ``lower`` and ``1 - upper``; nulls stay null."""
    names = chosen(df, columns, numeric(df))
    cuts = quantiles(df, names, [lower, 1 - upper])
    clip = lambda c: F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(cuts[c][0])), F.lit(cuts[c][1])))
    return replaced(df, {c: clip(c) for c in names if cuts[c]})


def remove_outliers_by_group(df: DataFrame, group_col: str, columns: Iterable[str] | None = None, k: float = 1.5) -> DataFrame:
    """Rows inside the fences of their group, column after column; nulls go, a null group is a group.

    Approximate percentiles bracket each rank, and only a group's values inside its brackets are ranked one by one, so that the task
    of a large group sees few of its values. A group of up to ``ACCURACY`` rows is ranked whole. Brackets and fences, a row or two a
    group, are broadcast where they are few: the rows of a large group never meet by their key.
    """
    kept = df.columns
    for c in [c for c in chosen(df, columns, numeric(df)) if c != group_col]:
        x = present(df, c)
        rows = df.where(x.isNotNull()).select(col(group_col).alias("g"), x.cast("double").alias("x"))
        slack = 3 / ACCURACY
        percents = [0.25 - slack, 0.25 + slack, 0.75 - slack, 0.75 + slack]
        sized = rows.groupBy("g").agg(F.count("*").alias("total"), F.percentile_approx("x", percents, ACCURACY).alias("p"))
        large = F.col("total") > ACCURACY
        low_of = lambda i: F.when(large, F.col("p")[i]).otherwise(F.lit(-math.inf))
        high_of = lambda i: F.when(large, F.col("p")[i]).otherwise(F.lit(math.inf))
        sides = [F.struct(F.lit(q).alias("q"), low_of(i).alias("low"), high_of(i + 1).alias("high")) for q, i in ((0.25, 0), (0.75, 2))]
        brackets = sized.select(F.col("g").alias("__g"), "total", F.array(*sides).alias("sides"))
        met = rows.join(small_side(brackets), F.col("g").eqNullSafe(F.col("__g"))).select("g", "total", "x", F.explode("sides").alias("s"))
        inside = (F.col("x") >= F.col("s.low")) & (F.col("x") <= F.col("s.high"))
        counts = met.where(F.col("x") <= F.col("s.high")).groupBy("g", "total", F.col("s.q").alias("q"), F.when(inside, F.col("x")).alias("x")).agg(F.count("*").alias("n"))
        by_value = Window.partitionBy("g", "q").orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("upto", F.sum("n").over(by_value))
        at = lambda q: F.min(F.when((F.col("q") == q) & (F.col("upto") >= F.floor(F.lit(q) * (F.col("total") - 1) + F.lit(0.5)) + 1), F.col("x")))
        fences = ranked.groupBy("g").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
        low, high = F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1")), F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1"))
        group, below, above = fresh_names(df, "group", "low", "high")
        fences = fences.select(F.col("g").alias(group), low.alias(below), high.alias(above))
        df = df.join(small_side(fences), col(group_col).eqNullSafe(F.col(group))).where(x.between(F.col(below), F.col(above))).select(*map(col, kept))
    return df


def check_skewness(df: DataFrame) -> dict[str, float]:
    """Skewness of the 64-bit number columns; NaN for empty and constant ones."""
    return {c: math.nan if v is None else v for c, v in skewnesses(df, core_numeric(df)).items()}


def _log1p(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(-math.inf)).when(x < -1, F.lit(math.nan))


def fix_skewness(df: DataFrame) -> DataFrame:
    """Columns skewed to the right by more than 1 as ``ln(x + 1)``."""
    return replaced(df, {c: _log1p(col(c)) for c, v in skewnesses(df, core_numeric(df)).items() if v is not None and v > 1})


def collinear_to_drop(df: DataFrame, threshold: float = 0.7, columns: list[str] | None = None) -> list[str]:
    """Columns correlated by more than ``threshold`` with any earlier one, dropped or not."""
    names = core_numeric(df) if columns is None else columns
    pairs = correlations(df, names)
    return [b for j, b in enumerate(names) if any(pairs[(a, b)] is not None and abs(pairs[(a, b)]) > threshold for a in names[:j])]


def check_multicollinearity(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    gone = set(collinear_to_drop(df, threshold))
    return df.select(*[col(c) for c in df.columns if c not in gone])


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``a``, ``b`` and ``corr`` for every pair of columns, both ways and with itself."""
    names = core_numeric(df) if columns is None else columns
    pairs = correlations(df, names)
    rows = [(a, b, 1.0 if a == b else pairs.get((a, b), pairs.get((b, a)))) for a in names for b in names]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")
