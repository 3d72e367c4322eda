"""Rare categories, near-equal spellings, encodings and value maps.

Defined cases: columns may have any names, those used inside included; nulls stay null; ties of frequency go by value; empty tables
give empty tables; values of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ratio import sorted_tokens
from millrace.functions.selectors import chosen, col, replaced, strings
from millrace.functions.stats import distinct_counts
from millrace.functions.storage import cut, fresh_name, fresh_names
from millrace.functions.text import literal_map
from millrace.operators.dedupe import heads, numbered

#: Maps up to this size are literals in the plan; larger ones are joined.
LITERAL_MAP = 200


def mapped(df: DataFrame, c: str, table: DataFrame, whole: bool = True) -> DataFrame:
    """``df`` with column ``c`` replaced by ``table``'s ``to`` for its ``from`` (null-safe); without a row it becomes null, or stays
    unless ``whole``.

    Spark broadcasts the table if it knows it to be small, and joins by shuffle otherwise.
    """
    old, new = fresh_names(df, "from", "to")
    joined = df.join(table.select(F.col("from").alias(old), F.col("to").alias(new)), col(c).eqNullSafe(F.col(old)), "left")
    to = F.col(new) if whole else F.coalesce(F.col(new), col(c))
    return joined.select(*[(to if x == c else col(x)).alias(x) for x in df.columns])


def group_rare_categories(df: DataFrame, threshold: float = 0.01, other_label: str = "Other", columns: Iterable[str] | None = None) -> DataFrame:
    """Values in fewer than ``threshold`` of all rows (nulls counted) become ``other_label``; null stays null."""
    rows = df.count()
    kept = df.columns
    for c in chosen(df, columns, strings(df)):
        counts = df.where(col(c).isNotNull()).groupBy(col(c).alias("from")).agg(F.count("*").alias("n"))
        to = F.when(F.col("n") / F.lit(rows) < threshold, F.lit(other_label)).otherwise(F.col("from").cast("string"))
        df = mapped(df, c, counts.select("from", to.alias("to")))
    return df.select(*map(col, kept))


def fuzzy_cluster_categories(df: DataFrame, columns: Iterable[str] | None = None, threshold: float = 90) -> DataFrame:
    """Spellings that resemble a more frequent one become that one.

    Distinct values, most frequent first (ties by value), are taken one by one: the first canonical value whose token-sorted
    similarity is at least ``threshold`` takes them in, else they become canonical themselves. Values of equal sorted tokens
    share a fate, so they are folded; the rest is settled by ``dedupe.heads``, at any number of values. Null stays null.
    """

    @F.pandas_udf("string")
    def token_sorted(x: pd.Series) -> pd.Series:
        return x.map(lambda s: sorted_tokens(s.lower()), na_action="ignore")

    for c in chosen(df, columns, strings(df)):
        counts = df.where(col(c).isNotNull()).groupBy(col(c).cast("string").alias("from")).agg((-F.count("*")).alias("at"))
        values = cut(numbered(counts).select("from", F.col("to").alias("place"), token_sorted("from").alias("key")))
        texts = cut(values.groupBy(F.col("key").alias("text")).agg(F.min("place").alias("place")))
        taken = texts.join(heads(texts, threshold), "place", "left").select("text", F.coalesce("head", "place").alias("head"))
        table = values.join(taken, F.col("key") == F.col("text")).where("place <> head").select("from", "head")
        df = mapped(df, c, table.join(values.select(F.col("place").alias("head"), F.col("from").alias("to")), "head").select("from", "to"), whole=False)
    return df


def replace_values(df: DataFrame, mapping: dict[str, dict[str, str]]) -> DataFrame:
    """Values of columns replaced by ``mapping``; those it lacks stay."""
    new: dict[str, Column] = {}
    for c, table in mapping.items():
        if c not in df.columns or not table:
            continue
        if len(table) <= LITERAL_MAP:
            new[c] = F.when(col(c).isin(*table), F.try_element_at(literal_map(table), col(c))).otherwise(col(c))
        else:
            df = mapped(df, c, df.sparkSession.createDataFrame(list(table.items()), "from string, to string"), whole=False)
    return replaced(df, new)


def correct_categorical_values(corrector: Callable[[str, list[str]], list[str] | str], column_name: str, values: list[str]) -> list[str]:
    """Corrections of ``values`` by a caller's function (a model, say): a list, or text with a value on each line.

    Leading ``- `` marks are stripped; an answer of the wrong length is ignored.
    """
    answer = corrector(column_name, values)
    lines = answer.strip().split("\n") if isinstance(answer, str) else list(answer)
    lines = [x.strip().removeprefix("- ").strip() for x in lines]
    return lines if len(lines) == len(values) else list(values)


def manual_correction(values: list[str], corrections: dict[str, str]) -> list[str]:
    return [corrections.get(v, v) for v in values]


def corrections_of(values: DataFrame, corrector: Callable, column_name: str, batch: int) -> DataFrame:
    """``from`` and ``to`` of the values (column ``from``) that ``corrector`` changes; tasks ask for ``batch`` values at a time."""

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), batch):
                asked = part["from"].iloc[a : a + batch].tolist()
                got = correct_categorical_values(corrector, column_name, asked)
                yield pd.DataFrame([(x, y) for x, y in zip(asked, got) if x != y], columns=["from", "to"], dtype=object)

    return values.mapInPandas(ask, "from string, to string")


def fix_spelling_errors_in_categorical(df: DataFrame, corrections: dict[str, dict[str, str]] | None = None, corrector: Callable | None = None, batch: int = 1000) -> DataFrame:
    """String columns corrected by a given mapping, or by a function over all their distinct values, ``batch`` at a time.

    The function runs in Spark's tasks (it must pickle); values and corrections stay in Spark. Given corrections come first.
    """
    given = {c: m for c, m in (corrections or {}).items() if c in df.columns}
    for c in strings(df) if corrector else ():
        values = df.select(col(c).alias("from")).where(col(c).isNotNull()).distinct().sort("from")
        found = corrections_of(values, corrector, c, batch)
        if given.get(c):
            own = df.sparkSession.createDataFrame(list(given[c].items()), "from string, to string")
            found = own.unionByName(found.join(own, "from", "left_anti"))
        df = mapped(df, c, cut(found), whole=False)
    return df if corrector else replace_values(df, given)


def encode_categorical(df: DataFrame, method: str = "onehot", columns: Iterable[str] | None = None, target: str | None = None, max_onehot: int = 20, order_by: str | None = None) -> DataFrame:
    """Encode string columns: ``onehot`` (0/1 columns, up to ``max_onehot`` values), ``label`` (by first appearance in
    ``order_by``), ``frequency``, ``ordinal`` (by code points) or ``target`` (mean of ``target``)."""
    names = chosen(df, columns, strings(df))
    kept = df.columns
    if method == "onehot":
        _, distinct = distinct_counts(df, names)
        few = [c for c in names if distinct[c] <= max_onehot]
        values = {c: sorted((r[0] for r in df.select(col(c)).distinct().collect()), key=lambda v: (v is None, v)) for c in few}
        out: list[Column] = []
        for c in kept:
            out += [col(c).eqNullSafe(F.lit(v)).cast("int").alias(f"{c}_{'null' if v is None else v}") for v in values[c]] if c in few else [col(c)]
        return df.select(*out)
    if method not in ("label", "frequency", "ordinal", "target"):
        raise ValueError(f"unknown encoding {method!r}")
    if method == "target" and target not in df.columns:
        raise ValueError("target encoding needs a target column")
    if method == "label" and order_by is None:
        order_by = fresh_name(df, "row")
        df = df.withColumn(order_by, F.monotonically_increasing_id())
    source = df
    for c in names:
        groups = source.groupBy(col(c).alias("from"))
        if method == "frequency":
            table = groups.agg(F.count("*").alias("to"))
        elif method == "target":
            table = groups.agg(F.avg(col(target)).alias("to"))
        else:
            first = groups.agg(F.min(col(order_by)).alias("at")) if method == "label" else groups.agg(F.min(col(c)).alias("at"))
            table = numbered(first.where(F.col("from").isNotNull()))
        df = mapped(df, c, table)
    return df.select(*map(col, kept))
