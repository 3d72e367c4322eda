"""Missing values: disguised ones, indicators, and imputation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.selectors import chosen, col, core_numeric, numeric, present, replaced, strings
from millrace.functions.stats import first_row, medians, null_counts
from millrace.functions.storage import cut
from millrace.functions.text import trim
from millrace.functions.words import MISSING
from millrace.operators.impute import impute_knn, impute_mice


def replace_disguised_missing(df: DataFrame, extra_sentinels: Iterable[str] | None = None, numeric_sentinels: Iterable[float] | None = None) -> DataFrame:
    """Strings that stand for a missing value become null, and so do the given numbers; everything else stays as it is."""
    words = sorted({w.strip().lower() for w in [*MISSING, *(extra_sentinels or [])]})
    new = {c: F.when(~F.coalesce(F.lower(trim(col(c))).isin(*words), F.lit(False)), col(c)) for c in strings(df)}
    if numeric_sentinels is not None:
        values = list(numeric_sentinels)
        new |= {c: F.when(~F.coalesce(col(c).cast("double").isin(*[float(v) for v in values]), F.lit(False)), col(c)) for c in numeric(df)} if values else {}
    return replaced(df, new)


def add_missing_indicators(df: DataFrame, suffix: str = "_missing") -> DataFrame:
    """A boolean column for each column that has a null."""
    _, nulls = null_counts(df, df.columns)
    return replaced(df, {f"{c}{suffix}": col(c).isNull() for c in df.columns if nulls[c]})


def _modes(df: DataFrame, names: list[str]) -> dict:
    """Most frequent non-null value of each column, the least of equals: folded by value, so no value list meets in a task."""
    out = {}
    for c in names:
        top = df.where(col(c).isNotNull()).groupBy(col(c).alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").first()
        out[c] = top["v"] if top else None
    return out


def _names(columns: str | Iterable[str] | None) -> list[str]:
    return [] if columns is None else [columns] if isinstance(columns, str) else list(columns)


def _filled_in_order(df: DataFrame, strategies: dict[str, str], order_by: str | list[str] | None, partition_by: str | list[str] | None) -> DataFrame:
    """``df`` with columns filled by ``ffill``, ``bfill`` or ``interpolate`` in the order of ``order_by`` within ``partition_by``.

    No task sees a whole key: rows are cut into ranges of (key, order), every range is filled by itself, and what it lacks comes
    from the ranges of the same key around it. A key has more than one range only where a range ends inside it, so the table
    of such ranges has at most two rows a range and is broadcast. Equal orders go by the order of reading, which also spreads them
    over ranges.
    """
    names, keys, orders = list(strategies), _names(partition_by), _names(order_by)
    key, order = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(1 + len(orders))]
    placed = [*map(col, orders), F.monotonically_increasing_id()]
    rows = df.select(
        F.struct(*map(col, df.columns)).alias("row"),
        *[present(df, c).alias(f"x{i}") for i, c in enumerate(names)],
        *[col(c).alias(k) for c, k in zip(keys, key)],
        *[e.alias(o) for e, o in zip(placed, order)],
    )
    rows = rows.repartitionByRange(*key, *order).withColumn("range", F.spark_partition_id())
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("range", *key).orderBy(*order)))
    rows = cut(rows.drop(*order))  # ranges are drawn anew by each run of the plan, so they are written once

    known = [(f"x{i}", F.when(F.col(f"x{i}").isNotNull(), F.col("at"))) for i in range(len(names))]
    ends = [e for x, at in known for e in (F.max_by(x, at).alias(f"last_{x}"), F.max(at).alias(f"last_at_{x}"), F.min_by(x, at).alias(f"first_{x}"), F.min(at).alias(f"first_at_{x}"))]
    ranges = rows.groupBy("range", *key).agg(F.max("at").alias("n"), *ends).withColumn("of_key", F.count("*").over(Window.partitionBy(*key))).where("of_key > 1")
    inside = Window.partitionBy(*key).orderBy("range")
    earlier, later = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(1, Window.unboundedFollowing)
    ranges = ranges.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    around = ranges.select(
        F.col("range").alias("a_range"),
        *[F.col(k).alias(f"a_{k}") for k in key],
        "start",
        *[e for x, _ in known for e in (
            F.last(f"last_{x}", True).over(earlier).alias(f"before_{x}"),
            F.last(F.col("start") + F.col(f"last_at_{x}"), True).over(earlier).alias(f"before_at_{x}"),
            F.first(f"first_{x}", True).over(later).alias(f"after_{x}"),
            F.first(F.col("start") + F.col(f"first_at_{x}"), True).over(later).alias(f"after_at_{x}"),
        )],
    )
    local = Window.partitionBy("range", *key).orderBy("at")
    before, after = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(0, Window.unboundedFollowing)
    near = rows.select(
        "*",
        *[e for x, at in known for e in (
            F.last(x, True).over(before).alias(f"own_before_{x}"),
            F.last(at, True).over(before).alias(f"own_before_at_{x}"),
            F.first(x, True).over(after).alias(f"own_after_{x}"),
            F.first(at, True).over(after).alias(f"own_after_at_{x}"),
        )],
    )
    same = F.col("range") == F.col("a_range")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"a_{k}"))
    joined = near.join(F.broadcast(around), same, "left")
    start = F.coalesce("start", F.lit(0))
    new = {}
    for (x, _), (c, strategy) in zip(known, strategies.items()):
        x0, x1 = F.coalesce(f"own_before_{x}", f"before_{x}"), F.coalesce(f"own_after_{x}", f"after_{x}")
        if strategy == "interpolate":  # on the line between the neighbours that are there; outside them null
            t, t0, t1 = start + F.col("at"), F.coalesce(start + F.col(f"own_before_at_{x}"), f"before_at_{x}"), F.coalesce(start + F.col(f"own_after_at_{x}"), f"after_at_{x}")
            line = x0.cast("double") + (x1.cast("double") - x0.cast("double")) * F.try_divide(t - t0, t1 - t0)
            new[c] = F.when(F.col(x).isNotNull(), F.col(x).cast("double")).otherwise(line)
        else:
            new[c] = x0 if strategy == "ffill" else x1
    return joined.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in df.columns])


def impute_missing(
    df: DataFrame,
    numeric_strategy: str = "median",
    categorical_strategy: str = "mode",
    constant_value=0,
    knn_neighbors: int = 5,
    columns: Iterable[str] | None = None,
    order_by: str | list[str] | None = None,
    partition_by: str | list[str] | None = None,
) -> DataFrame:
    """Fill nulls: numbers by ``mean|median|interpolate|ffill|bfill|constant|knn|mice``, strings by ``mode|ffill|bfill|constant``.

    The order-bound strategies follow ``order_by`` (default: the order in which rows were read; nulls first) within
    ``partition_by`` (null is a key of its own). Neither a hot key nor a table without keys passes one task.
    """
    if numeric_strategy not in ("mean", "median", "interpolate", "ffill", "bfill", "constant", "knn", "mice"):
        raise ValueError(f"unknown numeric strategy {numeric_strategy!r}")
    if categorical_strategy not in ("mode", "ffill", "bfill", "constant"):
        raise ValueError(f"unknown categorical strategy {categorical_strategy!r}")
    numbers, texts = ([c for c in chosen(df, columns, f(df)) if c in f(df)] for f in (numeric, strings))
    if numeric_strategy == "knn":
        df = impute_knn(df, numbers, knn_neighbors)
        numbers = []
    elif numeric_strategy == "mice":
        df = impute_mice(df, numbers)
        numbers = []
    _, nulls = null_counts(df.select(*[present(df, c).alias(c) if c in numbers else col(c) for c in [*numbers, *texts]]), [*numbers, *texts])
    numbers, texts = [c for c in numbers if nulls[c]], [c for c in texts if nulls[c]]
    ordered = {c: how for found, how in ((numbers, numeric_strategy), (texts, categorical_strategy)) if how in ("interpolate", "ffill", "bfill") for c in found}
    if ordered:
        df = _filled_in_order(df, ordered, order_by, partition_by)
    new: dict[str, Column] = {}
    if numeric_strategy in ("mean", "median"):
        values = first_row(df, {c: F.avg(present(df, c)) for c in numbers}) if numeric_strategy == "mean" else medians(df, numbers)
        new |= {c: F.coalesce(present(df, c).cast("double"), F.lit(values[c]).cast("double")) for c in numbers}
    elif numeric_strategy == "constant":
        new |= {c: F.coalesce(present(df, c), F.lit(constant_value)) for c in numbers}
    if categorical_strategy == "mode":
        modes = _modes(df, texts)
        new |= {c: F.coalesce(col(c), F.lit(modes[c]).cast("string")) for c in texts}
    elif categorical_strategy == "constant":
        new |= {c: F.coalesce(col(c), F.lit(str(constant_value))) for c in texts}
    return replaced(df, new)


def handle_missing_values(df: DataFrame, neighbors: int = 5, only_missing: bool = True) -> DataFrame:
    """KNN for 64-bit number columns, the most frequent value for strings. ``only_missing=False`` makes every number column
    double, also complete ones."""
    names = core_numeric(df)
    out = impute_knn(df, names, neighbors) if names else df
    if not only_missing:
        out = replaced(out, {c: col(c).cast("double") for c in names})
    texts = strings(df)
    modes = _modes(df, texts)
    return replaced(out, {c: F.coalesce(col(c), F.lit(modes[c]).cast(T.StringType())) for c in texts})
