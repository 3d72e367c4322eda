"""JSON in string columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.selectors import col, strings
from millrace.functions.stats import first_row
from millrace.functions.storage import fresh_names


def json_columns(df: DataFrame) -> list[str]:
    """String columns with at least one value that begins with ``{`` and ends with ``}``."""
    got = first_row(df, {c: F.max((col(c).startswith("{") & col(c).endswith("}")).cast("int")) for c in strings(df)})
    return [c for c in strings(df) if got[c]]


def fix_json_columns(df: DataFrame, schemas: dict[str, T.StructType] | None = None) -> DataFrame:
    """JSON columns replaced by a column ``<column>_<key>`` for each key, at the end. The schema of all values is merged in one
    aggregation (or given); values that do not parse give nulls."""
    schemas = dict(schemas or {})
    names = [c for c in json_columns(df) if c not in schemas]
    variant = lambda c: F.try_parse_json(F.when(col(c).startswith("{") & col(c).endswith("}"), col(c)))
    merged = first_row(df, {c: F.schema_of_variant_agg(variant(c)) for c in names})
    for c in names:
        text = merged[c].replace("OBJECT<", "STRUCT<")
        if text.startswith("STRUCT<") and text != "STRUCT<>":
            schemas[c] = T.StructType.fromDDL(f"v {text.replace('VOID', 'STRING')}")["v"].dataType
    ready = [c for c in df.columns if c in schemas]
    objects = fresh_names(df, *[f"object{i}" for i in range(len(ready))])
    parsed = df.withColumns({o: F.from_json(col(c), schemas[c]) for o, c in zip(objects, ready)})
    kept = [col(c) for c in df.columns if c not in ready]
    return parsed.select(*kept, *[F.col(o).getField(f.name).alias(f"{c}_{f.name}") for o, c in zip(objects, ready) for f in schemas[c]])
