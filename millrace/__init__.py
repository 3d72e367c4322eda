"""Spark-native data cleaning, profiling and corpus building.

Every function of the cleaning interface can be taken from here; modules are imported as they are needed, so that Python
workers load only what they run.
"""

from __future__ import annotations

import importlib

_NAMES = {
    "functions.text": """preprocess_text""".split(),
    "operators.balance": """check_and_handle_imbalance check_problem_type class_counts""".split(),
    "operators.categorical": """correct_categorical_values encode_categorical fix_spelling_errors_in_categorical fuzzy_cluster_categories group_rare_categories manual_correction replace_values""".split(),
    "operators.columns": """check_cardinality check_data_types coerce_numeric drop_empty_rows_and_columns drop_high_missing_columns drop_id_like_columns fix_incorrect_data_types fix_spelling_errors_in_columns missing_report remove_duplicate_columns standardize_column_names suggest_column_names""".split(),
    "operators.dedupe": """drop_duplicates_subset duplicate_count fuzzy_deduplicate handle_duplicates near_duplicate_text""".split(),
    "operators.domain": """canonicalize_urls convert_currency normalize_emails normalize_phone_numbers standardize_country_region""".split(),
    "operators.dtypes": """downcast_numeric extract_date_parts normalize_booleans parse_dates""".split(),
    "operators.eda": """generate_dashboard histogram kpis quality_issues value_counts""".split(),
    "operators.iforest": """remove_outliers_isolation_forest""".split(),
    "operators.jsoncols": """fix_json_columns""".split(),
    "operators.language": """detect_language filter_by_language learn_profiles""".split(),
    "operators.missing": """add_missing_indicators handle_missing_values impute_missing replace_disguised_missing""".split(),
    "operators.outliers": """check_multicollinearity check_outliers check_skewness collinear_to_drop correlation_matrix fix_skewness remove_outliers remove_outliers_by_group remove_outliers_mad remove_outliers_zscore winsorize""".split(),
    "operators.pii": """detect_and_mask_pii""".split(),
    "operators.scaling": """bin_numeric scale_numeric""".split(),
    "operators.strings": """fix_mojibake handle_negative_values normalize_unicode normalize_whitespace replace_symbols replace_symbols_and_convert_to_float standardize_casing standardize_categories""".split(),
    "operators.textprep": """correct_spelling_text detect_column_types_and_process_text detect_json_sample redact_profanity""".split(),
    "operators.validation": """apply_range_rules check_cross_field check_referential_integrity validate_formats""".split(),
    "plans.pipeline": """CleanConfig Pipeline clean_data""".split(),
    "sources.files": """load_data save_cleaned_data save_dashboard""".split(),
}
_WHERE = {name: module for module, names in _NAMES.items() for name in names}

__all__ = sorted(_WHERE)  # noqa: PLE0605


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(importlib.import_module(f"millrace.{_WHERE[name]}"), name)
    raise AttributeError(f"module 'millrace' has no attribute {name!r}")


def __dir__() -> list[str]:
    return [*globals(), *__all__]
