"""The end-to-end cleaning pipeline: a configuration instead of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from millrace.operators import balance, categorical, columns, dedupe, eda, jsoncols, missing, outliers, pii, strings, textprep
from millrace.sources.files import save_cleaned_data


@dataclass
class CleanConfig:
    """What each step does; every field has the default of the standard pipeline."""

    process_text: bool = True
    text_options: dict = field(default_factory=dict)
    expand_json: bool = True
    absolute_values: bool = True
    symbols_to_float: bool = True
    strict_compat: bool = False
    rename: dict[str, str] = field(default_factory=dict)
    corrections: dict[str, dict[str, str]] = field(default_factory=dict)
    strip_symbols: bool = True
    impute: bool = True
    deduplicate: bool = True
    drop_constant: bool = False
    remove_outliers: bool = False
    fix_skewness: bool = True
    collinearity: float | None = 0.7
    target: str | None = None
    balance: str | None = None
    mask_pii: bool = True
    dashboard: str | None = None
    output: str | None = None
    quantize: bool = True


@dataclass
class Pipeline:
    """Runs the configured steps in order; ``reports`` holds what each step found."""

    config: CleanConfig = field(default_factory=CleanConfig)
    reports: dict = field(default_factory=dict)

    def steps(self) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
        c = self.config

        def text(df: DataFrame) -> DataFrame:
            out, self.reports["column_types"] = textprep.detect_column_types_and_process_text(df, **c.text_options)
            return out

        def cardinality(df: DataFrame) -> DataFrame:
            out, self.reports["cardinality"] = columns.check_cardinality(df)
            return out if c.drop_constant else df

        def report(df: DataFrame) -> DataFrame:
            eda.generate_dashboard(df, c.dashboard)
            return df

        wanted = [
            (c.expand_json, "expand_json", jsoncols.fix_json_columns),
            (c.process_text, "process_text", text),
            (c.absolute_values, "absolute_values", strings.handle_negative_values),
            (c.symbols_to_float, "symbols_to_float", lambda df: strings.replace_symbols_and_convert_to_float(df, strict_compat=c.strict_compat)),
            (bool(c.rename), "rename", lambda df: columns.fix_spelling_errors_in_columns(df, c.rename)),
            (bool(c.corrections), "corrections", lambda df: categorical.replace_values(df, c.corrections)),
            (c.strip_symbols, "strip_symbols", strings.replace_symbols),
            (c.impute, "impute", missing.handle_missing_values),
            (c.deduplicate, "deduplicate", dedupe.handle_duplicates),
            (True, "cardinality", cardinality),
            (c.remove_outliers, "remove_outliers", outliers.remove_outliers),
            (c.fix_skewness, "fix_skewness", outliers.fix_skewness),
            (c.collinearity is not None, "collinearity", lambda df: outliers.check_multicollinearity(df, c.collinearity)),
            (c.target is not None, "balance", lambda df: balance.check_and_handle_imbalance(df, c.target, c.balance) if balance.check_problem_type(df, c.target) == "classification" else df),
            (c.dashboard is not None, "dashboard", report),
            (c.mask_pii, "mask_pii", pii.detect_and_mask_pii),
        ]
        return [(name, step) for on, name, step in wanted if on]

    def run(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps():
            df = step(df)
        return save_cleaned_data(df, self.config.output, self.config.quantize) if self.config.output else df


def clean_data(df: DataFrame, config: CleanConfig | None = None) -> DataFrame:
    return Pipeline(config or CleanConfig()).run(df)
