"""Scaling and binning: one aggregation for all columns, then a projection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.selectors import chosen, col, numeric, present, replaced
from millrace.functions.stats import first_row, medians, quantiles


def scale_numeric(df: DataFrame, method: str = "standard", columns: Iterable[str] | None = None) -> DataFrame:
    """``minmax``, ``standard`` (sample deviation) or ``robust`` (median and nearest-rank quartiles); constant columns stay."""
    names = chosen(df, columns, numeric(df))
    if method == "minmax":
        got = first_row(df, {(k, c): f(present(df, c)) for c in names for k, f in (("a", F.min), ("b", F.max))})
        centre, width = {c: got[("a", c)] for c in names}, {c: got[("b", c)] - got[("a", c)] if got[("a", c)] is not None else None for c in names}
    elif method == "standard":
        got = first_row(df, {(k, c): f(present(df, c)) for c in names for k, f in (("a", F.avg), ("b", F.stddev_samp))})
        centre, width = {c: got[("a", c)] for c in names}, {c: got[("b", c)] for c in names}
    elif method == "robust":
        centre, fences = medians(df, names), quantiles(df, names, [0.25, 0.75])
        width = {c: fences[c][1] - fences[c][0] if fences[c] else None for c in names}
    else:
        raise ValueError(f"unknown scaling {method!r}")
    return replaced(df, {c: (col(c) - F.lit(centre[c])) / F.lit(float(width[c])) for c in names if width[c]})


def number_text(x: float) -> str:
    """A break in a label: the shortest text that reads back as the number, without a needless fraction."""
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def bin_numeric(df: DataFrame, columns: Iterable[str], bins: int = 5, strategy: str = "quantile") -> DataFrame:
    """``<column>_bin``: the right-closed interval of each value, between distinct quantiles or (any other strategy) equal steps."""
    names = [c for c in columns if c in df.columns]
    if strategy == "quantile":
        cuts = {c: sorted(set(v)) for c, v in quantiles(df, names, [i / bins for i in range(1, bins)]).items()}
    else:
        got = first_row(df, {(k, c): f(present(df, c)) for c in names for k, f in (("lo", F.min), ("hi", F.max))})
        cuts = {}
        for c in names:
            lo, hi = got[("lo", c)], got[("hi", c)]
            cuts[c] = [lo + (hi - lo) / bins * i for i in range(1, bins)] if lo is not None and lo != hi else []
    new = {}
    for c in names:
        if cuts[c]:
            edges = ["-inf", *map(number_text, cuts[c]), "inf"]
            labels = [f"({a}, {b}]" for a, b in zip(edges, edges[1:])]
            x, label = present(df, c), None
            for cut, text in zip(cuts[c], labels):
                label = F.when(x <= cut, text) if label is None else label.when(x <= cut, text)
            new[f"{c}_bin"] = label.when(x.isNotNull(), labels[-1])
    return replaced(df, new)
