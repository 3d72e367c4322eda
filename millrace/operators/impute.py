"""Imputation by neighbours and by chained regressions.

KNN folds rows to distinct tuples of features; the incomplete ones find their neighbours among all of them through cells with
bounding boxes (``neighbours``), in joins, so no donor is left out and nothing of the size of the table comes to the driver. Chained
equations need only sums of products, which one aggregation a feature and round gives.

Defined cases: columns of any names; NaN counts as missing; repeated rows count as often as they occur; equal distances go by the
values; columns without any value stay as they are; empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.selectors import col, present, replaced
from millrace.functions.stats import first_row
from millrace.functions.storage import cut, fresh_names
from millrace.operators.neighbours import distances, nearest

#: Rows whose distances to all donors are held at once, in numbers.
CELLS = 4_000_000


def neighbour_means(x: np.ndarray, donors: np.ndarray, means: np.ndarray, k: int) -> np.ndarray:
    """``x`` with every NaN replaced by the mean over the ``k`` nearest donors that have the feature, ties by donor order."""
    out = x.copy()
    step = max(1, CELLS // max(1, len(donors)))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        far = distances(part, donors)
        for j in range(x.shape[1]):
            rows = np.flatnonzero(np.isnan(part[:, j]))
            own = np.flatnonzero(~np.isnan(donors[:, j]))
            if not len(rows):
                continue
            if not len(own):
                out[a + rows, j] = means[j]
                continue
            d = far[np.ix_(rows, own)]
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            usable = np.isfinite(np.take_along_axis(d, near, axis=1))
            values = np.where(usable, donors[own, j][near], 0.0)
            n = usable.sum(axis=1)
            out[a + rows, j] = np.where(n > 0, values.sum(axis=1) / np.maximum(n, 1), means[j])
    return out


def impute_knn(df: DataFrame, columns: list[str], k: int = 5, report: dict | None = None) -> DataFrame:
    """NaN-Euclidean nearest neighbours over ``columns``; those with a missing value become double, the others stay.

    A gap gets the mean of the ``k`` nearest rows that have the feature (equal distances by the rows' values, feature by feature), or
    the column's mean if no such row shares a feature. Columns without any value stay null; complete rows pass unchanged.
    ``report`` receives how many distances were computed, and how many all pairs would be.
    """
    exprs: dict = {("n", c): F.count(present(df, c)) for c in columns} | {("m", c): F.avg(present(df, c)) for c in columns} | {"rows": F.count(F.lit(1))}
    got = first_row(df, exprs)
    names = [c for c in columns if got[("n", c)]]
    gaps = [c for c in names if got[("n", c)] < got["rows"]]
    if not gaps:
        return df
    at = [names.index(c) for c in gaps]
    row = F.array(*[F.coalesce(present(df, c).cast("double"), F.lit(float("nan"))) for c in names])
    incomplete = F.coalesce(*[F.when(present(df, c).isNull(), True) for c in gaps], F.lit(False))
    tuples = cut(df.groupBy(row.alias("x")).agg(F.count("*").alias("n")))
    lacking = reduce(lambda a, b: a | b, [F.isnan(F.col("x")[j]) for j in at])
    queries = cut(tuples.where(lacking).select(F.monotonically_increasing_id().alias("q"), "x"))
    near = nearest(tuples, queries, len(names), at, k, report)
    value = F.element_at("x", F.col("j") + 1)
    means = near.groupBy("q", "j").agg((F.sum(value * F.col("take")) / F.sum("take")).alias("mean"))
    of_query = means.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("j", "mean"))).alias("means"))
    kept = df.columns
    own, tuple_, fill = fresh_names(df, "tuple", "of", "means")
    fills = cut(queries.join(of_query, "q").select(F.col("x").alias(tuple_), F.col("means").alias(fill)))
    found = df.where(incomplete).withColumn(own, row).join(fills, F.col(own) == F.col(tuple_), "left")
    new = {c: F.coalesce(present(df, c).cast("double"), F.try_element_at(fill, F.lit(j)), F.lit(float(got[("m", c)]))) for c, j in zip(gaps, at)}
    whole = replaced(df.where(~incomplete), {c: present(df, c).cast("double") for c in gaps})
    return whole.unionByName(replaced(found, new).select(*map(col, kept)))


def bayesian_ridge(gram: np.ndarray, xy: np.ndarray, yy: float, n: int, turns: int = 300, tolerance: float = 1e-3) -> np.ndarray:
    """Weights of a Bayesian ridge regression from sums over centred values alone (``gram``: X'X, ``xy``: X'y, ``yy``: y'y).

    The precisions of noise and of weights maximise the evidence: one eigendecomposition, then updates of two numbers.
    """
    values, vectors = np.linalg.eigh(gram)
    values, along = np.maximum(values, 0.0), vectors.T @ xy
    tiny = 1e-6
    noise, weight, before = 1.0 / (yy / n + np.finfo(float).eps), 1.0, None
    for _ in range(turns):
        w = vectors @ (along / (values + weight / noise))
        rest = max(yy - 2 * float(w @ xy) + float(w @ gram @ w), 0.0)
        known = float((noise * values / (weight + noise * values)).sum())
        weight = (known + 2 * tiny) / (float(w @ w) + 2 * tiny)
        noise = (n - known + 2 * tiny) / (rest + 2 * tiny)
        if before is not None and np.abs(before - w).sum() < tolerance:
            break
        before = w
    return vectors @ (along / (values + weight / noise))


def _solve(sums: dict, names: list[str], target: str) -> tuple[float, np.ndarray]:
    """Bayesian ridge regression of ``target`` on the others from sums of products: constant and weights."""
    others = [c for c in names if c != target]
    n = sums["n"]
    mean = {c: sums[("s", c)] / n for c in names}
    about = lambda a, b: sums[("p", *sorted((a, b)))] - n * mean[a] * mean[b]
    gram = np.array([[about(a, b) for b in others] for a in others]).reshape(len(others), len(others))
    weights = bayesian_ridge(gram, np.array([about(c, target) for c in others]), max(about(target, target), 0.0), n)
    return mean[target] - float(weights @ np.array([mean[c] for c in others])), weights


def impute_mice(df: DataFrame, columns: list[str], rounds: int = 10, tolerance: float = 1e-3) -> DataFrame:
    """Chained equations: each column with gaps is regressed on all others in turn (Bayesian ridge), from mean-filled values on.

    The fills are formulas over the original columns' values, rewritten each round; only sums come to the driver: for p columns
    p * (p + 1) / 2 of them a column and round, so p is meant to be in the tens. Rounds end early when coefficients hardly move.
    """
    got = first_row(df, {("n", c): F.count(present(df, c)) for c in columns} | {("m", c): F.avg(present(df, c)) for c in columns} | {"rows": F.count(F.lit(1))})
    names = [c for c in columns if got[("n", c)]]
    gaps = sorted((c for c in names if got[("n", c)] < got["rows"]), key=lambda c: -got[("n", c)])
    if not gaps:
        return df
    if len(names) < 2:
        return replaced(df, {c: F.coalesce(present(df, c).cast("double"), F.lit(got[("m", c)])) for c in gaps})
    short = dict(zip(names, fresh_names(df, *[f"x{i}" for i in range(len(names))])))
    lacks = dict(zip(names, fresh_names(df, *[f"gap{i}" for i in range(len(names))])))
    work = df.withColumns({short[c]: F.coalesce(present(df, c).cast("double"), F.lit(got[("m", c)])) for c in names} | {lacks[c]: present(df, c).isNull() for c in names})
    previous: dict[str, np.ndarray] = {}
    for turn in range(rounds):
        moved = 0.0
        for c in gaps:
            known = ~F.col(lacks[c])
            value = lambda a: F.when(known, F.col(short[a]))
            exprs: dict = {"n": F.count(F.when(known, 1))} | {("s", a): F.sum(value(a)) for a in names}
            exprs |= {("p", *sorted((a, b))): F.sum(value(a) * F.col(short[b])) for i, a in enumerate(names) for b in names[: i + 1]}
            constant, weights = _solve(first_row(work, exprs), names, c)
            others = [a for a in names if a != c]
            guess: Column = F.lit(constant)
            for a, w in zip(others, weights):
                guess = guess + F.lit(float(w)) * F.col(short[a])
            work = work.withColumn(short[c], F.when(F.col(lacks[c]), guess).otherwise(F.col(short[c])))
            now = np.append(weights, constant)
            moved = max(moved, float(np.max(np.abs(now - previous[c]) / (1e-9 + np.abs(now).max()))) if c in previous else np.inf)
            previous[c] = now
        if len(gaps) > 1:
            work = cut(work) if turn % 2 else work
        if len(gaps) == 1 or moved < tolerance:
            break
    return replaced(work, {c: F.col(short[c]) for c in gaps}).select(*map(col, df.columns))
