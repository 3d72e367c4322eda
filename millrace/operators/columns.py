"""Names, constant, empty, duplicate and identifier-like columns."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.selectors import FLOATS, col, strings
from millrace.functions.stats import distinct_counts, first_row, null_counts
from millrace.functions.storage import fresh_name
from millrace.functions.text import number

#: Names of identifier columns (fixed values, in any case).
ID_NAMES = ("id", "uuid", "guid", "index", "_id")
#: Where a word of a name ends: at white space, at underscores, before the capital that follows a small letter or digit.
_WORD_ENDS = re.compile(r"[\s_]+|(?<=[a-z0-9])(?=[A-Z])")


def snake_case(name: str) -> str:
    """The words of a name without punctuation, in small letters, joined by underscores."""
    words = ["".join(filter(lambda ch: ch == "_" or ch.isalnum(), w)) for w in _WORD_ENDS.split(str(name))]
    return "_".join(w for w in words if w).lower() or "column"


def standardize_column_names(df: DataFrame) -> DataFrame:
    """Names in snake case; of equal names the second gets ``_1``, the third ``_2`` and so on."""
    names = [snake_case(c) for c in df.columns]
    earlier = [names[:i].count(n) for i, n in enumerate(names)]
    return df.toDF(*[f"{n}_{k}" if k else n for n, k in zip(names, earlier)])


def drop_empty_rows_and_columns(df: DataFrame) -> DataFrame:
    """Without columns that are null throughout, then without rows that are. A table without rows keeps its columns."""
    rows, nulls = null_counts(df, df.columns)
    if not rows:
        return df
    kept = [c for c in df.columns if nulls[c] < rows]
    return df.select(*map(col, kept)).where(F.coalesce(*[F.when(col(c).isNotNull(), True) for c in kept], F.lit(False)) if kept else F.lit(False))


def drop_high_missing_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    rows, nulls = null_counts(df, df.columns)
    return df.select(*[col(c) for c in df.columns if nulls[c] / (rows or 1) <= threshold])


def remove_duplicate_columns(df: DataFrame) -> DataFrame:
    """Without columns that equal an earlier one in type and in every row; a column with a NaN equals none.

    Columns of one type are told apart by sums of row-bound hashes; those that agree are compared value by value.
    """
    types = dict(df.dtypes)
    row = fresh_name(df, "row")
    keyed = df.withColumn(row, F.monotonically_increasing_id())
    nan = {c: F.max(F.isnan(col(c)).cast("int")) for c in df.columns if isinstance(df.schema[c].dataType, FLOATS)}
    maps = {c for c in df.columns if "map<" in types[c]}
    prints = first_row(keyed, {c: F.expr(f"bit_xor(xxhash64({row}, `{c.replace('`', '``')}`))") for c in df.columns if c not in maps} | {("nan", c): e for c, e in nan.items()})
    pairs = [(a, b) for j, b in enumerate(df.columns) for a in df.columns[:j] if types[a] == types[b] and a not in maps and b not in maps and prints[a] == prints[b] and not prints.get(("nan", b))]
    same = first_row(df, {(a, b): F.bool_and(col(a).eqNullSafe(col(b))) for a, b in pairs})
    gone = {b for (a, b), equal in same.items() if equal or equal is None}
    return df.select(*[col(c) for c in df.columns if c not in gone])


def drop_id_like_columns(df: DataFrame, uniqueness: float = 0.99) -> DataFrame:
    """Without columns whose values hardly repeat, or that are named like an identifier and repeat little."""
    rows, distinct = distinct_counts(df, df.columns)
    if not rows:
        return df
    ratio = {c: distinct[c] / rows for c in df.columns}
    gone = {c for c in df.columns if ratio[c] >= uniqueness or (c.replace(" ", "_").lower() in ID_NAMES and ratio[c] > 0.9)}
    return df.select(*[col(c) for c in df.columns if c not in gone])


def check_cardinality(df: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Distinct values of the string columns, and ``df`` without those that have just one."""
    _, distinct = distinct_counts(df, strings(df))
    return df.select(*[col(c) for c in df.columns if distinct.get(c) != 1]), distinct


def check_data_types(df: DataFrame) -> list[str]:
    return [kind for _, kind in df.dtypes]


def fix_spelling_errors_in_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns renamed by ``mapping``; names that do not occur are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def suggest_column_names(df: DataFrame, known: list[str] | None = None, cutoff: float = 0.8) -> dict[str, str]:
    """For each name the closest other one (of ``known``, or of the table) that is similar enough."""
    out = {}
    for name in df.columns:
        near = difflib.get_close_matches(name, [k for k in (known or df.columns) if k != name], n=1, cutoff=cutoff)
        if near:
            out[name] = near[0]
    return out


def coerce_numeric(df: DataFrame, columns: list[str] | None = None, min_success: float = 1.0) -> DataFrame:
    """String columns as doubles where at least ``min_success`` of their non-null values are numbers."""
    names = [c for c in (strings(df) if columns is None else columns) if c in df.columns]
    got = first_row(df, {(k, c): F.count(e) for c in names for k, e in (("all", col(c)), ("ok", number(col(c).cast("string"))))})
    ready = {c for c in names if got[("all", c)] and got[("ok", c)] / got[("all", c)] >= min_success}
    return df.select(*[(number(col(c).cast("string")) if c in ready else col(c)).alias(c) for c in df.columns])


fix_incorrect_data_types = coerce_numeric


def missing_report(df: DataFrame) -> DataFrame:
    """``column``, ``missing`` and ``share`` for every column."""
    exprs: list[Column] = [F.struct(F.lit(c).alias("column"), F.count(F.when(col(c).isNull(), 1)).alias("missing"), F.try_divide(F.count(F.when(col(c).isNull(), 1)), F.count(F.lit(1))).alias("share")) for c in df.columns]
    return df.agg(F.array(*exprs).alias("r")).select(F.explode("r").alias("r")).select("r.*")
