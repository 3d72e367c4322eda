"""Row-local steps over streams.

These steps look at one row at a time and need no statistics, so they run unchanged on a streaming table; steps that profile
the table first do not, and are refused before a stream starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import domain, dtypes, missing, strings, textprep, validation

ROW_LOCAL: dict[str, Callable[..., DataFrame]] = {
    "normalize_whitespace": strings.normalize_whitespace,
    "normalize_unicode": strings.normalize_unicode,
    "fix_mojibake": strings.fix_mojibake,
    "standardize_casing": strings.standardize_casing,
    "standardize_categories": strings.standardize_categories,
    "handle_negative_values": strings.handle_negative_values,
    "replace_disguised_missing": missing.replace_disguised_missing,
    "extract_date_parts": dtypes.extract_date_parts,
    "normalize_booleans": dtypes.normalize_booleans,
    "apply_range_rules": validation.apply_range_rules,
    "validate_formats": validation.validate_formats,
    "normalize_phone_numbers": domain.normalize_phone_numbers,
    "normalize_emails": domain.normalize_emails,
    "canonicalize_urls": domain.canonicalize_urls,
    "standardize_country_region": domain.standardize_country_region,
    "convert_currency": domain.convert_currency,
    "preprocess_text_columns": textprep.preprocess_text_columns,
}


def apply_steps(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Named row-local steps with their arguments, one after another."""
    for name, options in steps:
        if name not in ROW_LOCAL:
            raise ValueError(f"{name!r} needs statistics of the whole table, or is unknown; it can't run on a stream")
        if name == "normalize_booleans" and not options.get("columns"):
            raise ValueError("normalize_booleans needs its columns on a stream")
        df = ROW_LOCAL[name](df, **options)
    return df


def clean_stream(df: DataFrame, steps: list[tuple[str, dict]], path: str, checkpoint: str, trigger: dict | None = None, watermark: tuple[str, str] | None = None, deduplicate: list[str] | None = None) -> StreamingQuery:
    """Clean a streaming table and append it to Parquet files, exactly once. ``deduplicate``: keys that are kept once within
    the ``watermark`` (column and delay), so that state stays bounded."""
    out = apply_steps(df, steps)
    if watermark:
        out = out.withWatermark(*watermark)
    if deduplicate:
        if not watermark:
            raise ValueError("deduplication of a stream needs a watermark")
        out = out.dropDuplicatesWithinWatermark(deduplicate)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
