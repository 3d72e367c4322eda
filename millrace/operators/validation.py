"""Rules on values: ranges, cross-field checks, formats, references."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.selectors import col, replaced
from millrace.functions.stats import first_row
from millrace.functions.storage import fresh_name
from millrace.functions.words import FORMATS


def apply_range_rules(df: DataFrame, rules: dict[str, tuple], action: str = "null") -> DataFrame:
    """Values outside ``(low, high)``: ``null`` them, ``clip`` them, or ``drop`` their rows (nulls stay)."""
    if action not in ("null", "clip", "drop"):
        raise ValueError(f"unknown action {action!r}")
    rules = {c: r for c, r in rules.items() if c in df.columns}
    if action == "drop":
        for c, (low, high) in rules.items():
            df = df.where(col(c).isNull() | col(c).between(low, high))
        return df
    if action == "null":
        return replaced(df, {c: F.when(col(c).between(*r), col(c)) for c, r in rules.items()})
    return replaced(df, {c: F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high))) for c, (low, high) in rules.items()})


def range_report(df: DataFrame, rules: dict[str, tuple]) -> dict[str, int]:
    """Non-null values outside each range, all counted in one pass."""
    return first_row(df, {c: F.count(F.when(~col(c).between(*r), 1)) for c, r in rules.items() if c in df.columns})


def _condition(check: Column | str) -> Column:
    return F.expr(check) if isinstance(check, str) else check


def cross_field_report(df: DataFrame, checks: dict[str, Column | str]) -> dict[str, int]:
    return first_row(df, {name: F.count(F.when(~F.coalesce(_condition(c), F.lit(True)), 1)) for name, c in checks.items()})


def check_cross_field(df: DataFrame, checks: dict[str, Column | str], drop_violations: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """Rows that break each named condition (columns or SQL text; an unknown result counts as kept), and the table, on demand
    without them. Counts when dropping are those of the rows that earlier conditions left."""
    if not drop_violations:
        return df, cross_field_report(df, checks)
    exprs, passed = {}, F.lit(True)
    for name, c in checks.items():
        held = F.coalesce(_condition(c), F.lit(True))
        exprs[name] = F.count(F.when(passed & ~held, 1))
        passed = passed & held
    return df.where(passed), first_row(df, exprs)


def validate_formats(df: DataFrame, specs: dict[str, str], add_flag: bool = True) -> DataFrame:
    """``<column>_valid`` for columns of kind ``email|url|ip|phone|postal``; null for null. Unknown kinds are skipped."""
    new = {f"{c}_valid": col(c).cast("string").rlike(FORMATS[kind]) for c, kind in specs.items() if c in df.columns and kind in FORMATS}
    return replaced(df, new) if add_flag else df


def format_report(df: DataFrame, specs: dict[str, str]) -> dict[str, int]:
    return first_row(df, {c: F.count(F.when(~col(c).cast("string").rlike(FORMATS[k]), 1)) for c, k in specs.items() if c in df.columns and k in FORMATS})


def check_referential_integrity(df: DataFrame, column: str, valid_values: Iterable | DataFrame, drop_invalid: bool = False) -> tuple[DataFrame, int]:
    """How many non-null values are not among ``valid_values`` (a list, or a table's first column), and the table, on demand
    without their rows."""
    if isinstance(valid_values, DataFrame):
        key = fresh_name(df, "key")
        keys = valid_values.select(valid_values[valid_values.columns[0]].alias(key)).distinct()
        bad = df.where(col(column).isNotNull()).join(keys, col(column) == F.col(key), "left_anti")
        kept = df.join(keys, col(column) == F.col(key), "left").where(col(column).isNull() | F.col(key).isNotNull()).select(*map(col, df.columns))
        return (kept if drop_invalid else df), bad.count()
    fits = col(column).isin(*list(valid_values))
    bad = df.where(~fits & col(column).isNotNull()).count()
    return (df.where(fits | col(column).isNull()) if drop_invalid else df), bad
