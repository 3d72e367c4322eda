"""Problem type and class balance.

Defined cases: columns may have any names; rows without a label are kept and belong to no class; repeated rows are rows of their own;
empty tables and tables of one class are returned as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.selectors import col, signed_numeric
from millrace.functions.stats import distinct_counts
from millrace.functions.storage import cut, fresh_names

#: Hash slots in which the rows of a class are counted.
SLOTS = 4096


def check_problem_type(df: DataFrame, target_col: str) -> str:
    """``regression`` for a number column with more than ten values, else ``classification``."""
    if target_col not in signed_numeric(df):
        return "classification"
    return "regression" if distinct_counts(df, [target_col])[1][target_col] > 10 else "classification"


def class_counts(df: DataFrame, target_col: str) -> DataFrame:
    return df.groupBy(col(target_col)).agg(F.count("*").alias("count")).orderBy("count", col(target_col))


def _exact(rows: DataFrame, label: str, quota: DataFrame, seed: int) -> DataFrame:
    """``need`` rows of each class (``quota``: ``class`` and ``need``), by hash order: rows under a threshold go whole, ties at it are ranked.

    A count for each (class, hash slot) tells in which slot the quota ends; only that slot is ranked, so no class passes one
    task. Counts and quotas stay tables, however many classes there are.
    """
    kept = rows.columns
    hash_, slot, rank, class_, cut_at, rest = fresh_names(rows, "hash", "slot", "rank", "class", "cut", "rest")
    placed = cut(rows.withColumn(hash_, F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))).withColumn(slot, F.pmod(hash_, F.lit(SLOTS)))
    counts = placed.groupBy(col(label).alias("class"), F.col(slot).alias("slot")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("class").orderBy("slot"))
    ends = counts.withColumn("upto", upto).join(quota, "class").where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    ends = ends.select(F.col("class").alias(class_), F.col("slot").alias(cut_at), (F.col("need") - F.col("upto") + F.col("n")).alias(rest))
    joined = placed.join(ends, col(label) == F.col(class_))
    whole = joined.where(F.col(slot) < F.col(cut_at)).select(*map(col, kept))
    edge = joined.where(F.col(slot) == F.col(cut_at)).withColumn(rank, F.row_number().over(Window.partitionBy(class_).orderBy(hash_)))
    return whole.unionByName(edge.where(F.col(rank) <= F.col(rest)).select(*map(col, kept)))


def check_and_handle_imbalance(df: DataFrame, target_col: str, method: str | None = None, seed: int = 42, ratio: float = 1.5) -> DataFrame:
    """Equal class sizes if the largest class exceeds ``ratio`` times the least: ``over`` (repeat rows up to the largest) or
    ``under`` (exact samples of the least size). Without a method the table is returned as it is; rows without a label stay."""
    if method not in (None, "over", "under"):
        raise ValueError("method must be 'over' or 'under'")
    labelled = df.where(col(target_col).isNotNull())
    sizes = cut(labelled.groupBy(col(target_col).alias("class")).agg(F.count("*").alias("n")))
    classes, least, most = sizes.agg(F.count("*"), F.min("n"), F.max("n")).first()
    if method is None or classes < 2 or most / least <= ratio:
        return df
    if method == "under":
        out = _exact(labelled, target_col, sizes.select("class", F.lit(least).alias("need")), seed)
    else:
        class_, times = fresh_names(df, "class", "times")
        copies = sizes.select(F.col("class").alias(class_), F.explode(F.sequence(F.lit(1), F.floor(F.lit(most) / F.col("n")).cast("int"))).alias(times))
        out = labelled.join(copies, col(target_col) == F.col(class_)).select(*map(col, df.columns))
        out = out.unionByName(_exact(labelled, target_col, sizes.select("class", (F.lit(most) % F.col("n")).alias("need")).where("need > 0"), seed))
    return out.unionByName(df.where(col(target_col).isNull()))
