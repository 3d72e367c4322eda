"""Isolation forest: trees over small samples, grown on the driver, scored in tasks."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.selectors import chosen, numeric, present
from millrace.functions.stats import first_row
from millrace.functions.storage import fresh_name

SAMPLE, TREES = 256, 100


def _path(n: float) -> float:
    """Average path length of a search tree of ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
    """Arrays of a tree: split feature (-1: leaf), threshold, children, and the depth that a leaf stands for."""
    feature, threshold, left, right, depth = [], [], [], [], []

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(feature)
        for column, value in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (depth, level + _path(len(rows)))):
            column.append(value)
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        open_features = np.flatnonzero(high > low)
        if level < limit and len(rows) > 1 and len(open_features):
            f = int(rng.choice(open_features))
            cut = rng.uniform(low[f], high[f])
            feature[at], threshold[at] = f, cut
            left[at] = grow(rows[x[rows, f] < cut], level + 1)
            right[at] = grow(rows[x[rows, f] >= cut], level + 1)
        return at

    grow(np.arange(len(x)), 0)
    return tuple(map(np.array, (feature, threshold, left, right, depth)))


def anomaly_scores(x: np.ndarray, trees: list[tuple[np.ndarray, ...]], sample: int) -> np.ndarray:
    """Between 0 and 1; higher is more isolated."""
    total = np.zeros(len(x))
    for feature, threshold, left, right, depth in trees:
        at = np.zeros(len(x), int)
        while True:
            live = np.flatnonzero(feature[at] >= 0)
            if not len(live):
                break
            node = at[live]
            at[live] = np.where(x[live, feature[node]] < threshold[node], left[node], right[node])
        total += depth[at]
    return 2.0 ** (-total / len(trees) / max(_path(sample), 1e-9))


def remove_outliers_isolation_forest(df: DataFrame, contamination: float = 0.05, columns: Iterable[str] | None = None, seed: int = 42) -> DataFrame:
    """Without the ``contamination`` share of rows that isolate fastest; nulls count as the column's mean.

    The forest needs samples of 256 rows, whatever the input (a bound of the method), drawn by row, so a value is met as often
    as rows hold it; all rows are scored, and the cut is a quantile of all scores.
    """
    names = chosen(df, columns, numeric(df))
    if not names:
        return df
    means = first_row(df, {c: F.avg(present(df, c)) for c in names} | {"": F.count(F.lit(1))})
    rows = means.pop("")
    if not rows:
        return df
    row = F.array(*[F.coalesce(present(df, c).cast("double"), F.lit(means[c] or 0.0)) for c in names])
    pool = df.select(row.alias("x"), F.rand(seed).alias("h")).where(F.col("h") < SAMPLE * 16 / rows).orderBy("h").limit(SAMPLE * 32).toPandas()
    x = np.array(pool["x"].tolist(), float).reshape(len(pool), len(names))
    if not len(x):
        return df
    rng = np.random.default_rng(seed)
    size = min(SAMPLE, len(x))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    trees = [_tree(x[rng.choice(len(x), size, replace=False)], rng, limit) for _ in range(TREES)]
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(anomaly_scores(np.array(part.tolist(), float).reshape(len(part), -1), shared.value, size), dtype=float)

    name = fresh_name(df, "score")
    scored = df.withColumn(name, score(row))
    cut = scored.agg(F.percentile_approx(name, F.lit(1 - contamination), F.lit(100_000))).first()[0]
    return scored.where(F.col(name) <= cut).drop(name)
