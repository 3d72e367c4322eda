"""Statistics that decide a plan, gathered for all columns in as few aggregations as possible.

Order statistics are exact at any size: small inputs take one grouped aggregation; large ones are bracketed by approximate
percentiles first, so that only values near the wanted rank are counted one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.selectors import FLOATS, col, present

#: Rows up to which all distinct values of a column may meet in one aggregation.
DIRECT_ROWS = 2_000_000
ACCURACY = 100_000


def first_row(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """One aggregation over ``df``: results by name."""
    if not exprs:
        return {}
    keys = list(exprs)
    row = df.agg(*[exprs[k].alias(f"a{i}") for i, k in enumerate(keys)]).first()
    return dict(zip(keys, row))


def null_counts(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    got = first_row(df, {"": F.count(F.lit(1))} | {c: F.count(F.when(col(c).isNull(), 1)) for c in columns})
    return got.pop(""), got


def distinct_counts(df: DataFrame, columns: list[str], batch: int = 8) -> tuple[int, dict[str, int]]:
    """Rows, and distinct values by column, a null counted as a value. Batched: each distinct count multiplies the rows."""
    rows, out = None, {}
    for k in range(0, max(1, len(columns)), batch):
        part = columns[k : k + batch]
        exprs = {("n", ""): F.count(F.lit(1))}
        for c in part:
            exprs[("d", c)] = F.count_distinct(col(c))
            exprs[("z", c)] = F.max(col(c).isNull().cast("int"))
        got = first_row(df, exprs)
        rows = got[("n", "")]
        out |= {c: got[("d", c)] + (got[("z", c)] or 0) for c in part}
    return rows, out


def nearest_rank(q: float, n: int) -> int:
    """Zero-based rank of quantile ``q``: halves go up."""
    return int(math.floor(q * (n - 1) + 0.5))


def order_statistics(df: DataFrame, wanted: dict[str, Callable[[int], list[int]]], direct_rows: int | None = None) -> dict[str, list]:
    """For each column the values at zero-based ranks among its sorted non-null, non-NaN values (empty without values)."""
    direct_rows = DIRECT_ROWS if direct_rows is None else direct_rows
    counts = first_row(df, {c: F.count(present(df, c)) for c in wanted})
    ranks = {(c, i): r for c, f in wanted.items() if counts[c] for i, r in enumerate(f(counts[c]))}
    exact: dict[tuple, Column] = {}
    large = {k: r for k, r in ranks.items() if counts[k[0]] > direct_rows}
    for (c, i), r in list(large.items()):
        if r in (0, counts[c] - 1):  # the least and the greatest need no rank
            exact[(c, i)] = (F.max if r else F.min)(present(df, c)).cast("double")
            del large[(c, i)]
    shared: dict[str, list[int]] = {}  # ranks of a column that one aggregate gives together
    for c in {c: 0 for c, _ in ranks if counts[c] <= direct_rows}:
        shares = {i: _share(r, counts[c]) for (x, i), r in ranks.items() if x == c}
        shared[c] = [i for i, p in shares.items() if p is not None]
        if shared[c]:
            exact[(c, "all")] = F.expr(f"percentile({_sql(df, c)}, array({', '.join(f'{shares[i]!r}D' for i in shared[c])}))")
        exact |= {(c, i): _at(_sql(df, c), ranks[(c, i)], counts[c]) for i, p in shares.items() if p is None}
    if large:
        percents: dict[str, list[float]] = {}
        for (c, i), r in large.items():
            centre, slack = (r + 0.5) / counts[c], 3 / ACCURACY
            percents.setdefault(c, []).extend([max(0.0, centre - slack), min(1.0, centre + slack)])
        got = first_row(df, {c: F.percentile_approx(present(df, c), p, ACCURACY) for c, p in percents.items()})  # one summary a column
        sides = {c: iter(v) for c, v in got.items()}
        bounds = {(c, i, side): next(sides[c]) for c, i in large for side in ("low", "high")}
        inside, below = {}, {}
        for c, i in large:
            x, low, high = present(df, c), F.lit(bounds[(c, i, "low")]), F.lit(bounds[(c, i, "high")])
            inside[(c, i)] = f"CASE WHEN {_sql(df, c)} BETWEEN {_literal(bounds[(c, i, 'low')])} AND {_literal(bounds[(c, i, 'high')])} THEN {_sql(df, c)} END"
            below[("b", c, i)] = F.count(F.when(x < low, 1))
            below[("n", c, i)] = F.count(F.when((x >= low) & (x <= high), 1))
        seen = first_row(df, below)
        for (c, i), r in large.items():
            at, n = r - seen[("b", c, i)], seen[("n", c, i)]
            if 0 <= at < n:
                exact[(c, i)] = _at(inside[(c, i)], at, n)
            else:  # the approximation missed the rank: all values are ranked
                exact[(c, i)] = _at(_sql(df, c), r, counts[c])
    got = first_row(df, exact)
    got |= {(c, i): v for c, at in shared.items() if at for i, v in zip(at, got[(c, "all")])}
    return {c: [got[(c, i)] for i in range(len(wanted[c](counts[c])))] if counts[c] else [] for c in wanted}


def _sql(df: DataFrame, c: str) -> str:
    """The column as SQL text, NaN as null; only SQL has the ordered-set form that ranks need."""
    name = "`" + c.replace("`", "``") + "`"
    return f"nanvl({name}, NULL)" if isinstance(df.schema[c].dataType, FLOATS) else name


def _literal(value: float | int) -> str:
    return f"double('{value!r}')" if isinstance(value, float) else str(value)


def _share(rank: int, n: int) -> float | None:
    """A number whose product with ``n - 1`` is ``rank`` to the last bit, so that nothing is interpolated; None if there is none."""
    p = rank / max(1, n - 1)
    return next((q for q in (p, math.nextafter(p, 0.0), math.nextafter(p, 1.0)) if q * (n - 1) == rank), None)


def _at(x: str, rank: int, n: int) -> Column:
    """The value at a rank: the middle of its step of the cumulative distribution."""
    return F.expr(f"percentile_disc({(rank + 0.5) / n!r}D) WITHIN GROUP (ORDER BY {x})")


def quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list]:
    """Nearest-rank quantiles."""
    return order_statistics(df, {c: (lambda n: [nearest_rank(q, n) for q in qs]) for c in columns})


def iqr_fences(df: DataFrame, columns: list[str], k: float = 1.5) -> dict[str, tuple[float, float] | None]:
    """Lower and upper fence by column; None for a column without values."""
    return {c: (v[0] - k * (v[1] - v[0]), v[1] + k * (v[1] - v[0])) if v else None for c, v in quantiles(df, columns, [0.25, 0.75]).items()}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Medians; the mean of the two middle values of an even number."""
    got = order_statistics(df, {c: (lambda n: [(n - 1) // 2, n // 2]) for c in columns})
    return {c: (v[0] + v[1]) / 2 if v else None for c, v in got.items()}


def skewness(x: Column) -> Column:
    """Biased Fisher-Pearson skewness; null if empty or constant."""
    return F.skewness(x)


def skewnesses(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return first_row(df, {c: skewness(present(df, c)) for c in columns})


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over pairs where both are there; null if either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """All pairs (earlier, later), in one aggregation."""
    pairs = [(a, b) for j, b in enumerate(columns) for a in columns[:j]]
    return first_row(df, {(a, b): correlation(present(df, a), present(df, b)) for a, b in pairs})
