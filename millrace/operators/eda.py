"""Profile tables and a small HTML report. Only aggregates and bounded previews reach the driver."""

from __future__ import annotations

import html as markup

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.selectors import col, core_numeric, present, strings
from millrace.functions.stats import correlations, distinct_counts, first_row, iqr_fences, nearest_rank, null_counts, order_statistics, skewnesses
from millrace.operators.dedupe import duplicate_count
from millrace.sources.files import save_dashboard

TOP = 20
BINS = 20
PREVIEW = 8
SCATTER_ROWS, SCATTER_GROUPS, BOX_GROUPS, CROSS_GROUPS = 5000, 10, 30, 10


def value_counts(df: DataFrame, column: str, top: int = TOP) -> DataFrame:
    """``value`` and ``count`` of the most frequent non-null values (ties by value)."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(top)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """``bin`` (from 1), its bounds ``low`` and ``high``, and ``count``, in equal steps from the least to the greatest value."""
    x = present(df, column).cast("double")
    got = first_row(df, {"lo": F.min(x), "hi": F.max(x)})
    lo, hi = got["lo"], got["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count long")
    step = (hi - lo) / bins or 1.0
    at = F.least(F.floor((x - F.lit(lo)) / F.lit(step)).cast("int") + 1, F.lit(bins))
    counts = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    return counts.select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(step)).alias("low"), (F.lit(lo) + F.col("bin") * F.lit(step)).alias("high"), "count")


def five_numbers(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict[str, float]]:
    """Least, quartiles (nearest rank), median and greatest of number columns."""
    names = core_numeric(df) if columns is None else columns
    got = order_statistics(df, {c: (lambda n: [0, nearest_rank(0.25, n), (n - 1) // 2, n // 2, nearest_rank(0.75, n), n - 1]) for c in names})
    return {c: {"min": v[0], "q1": v[1], "median": (v[2] + v[3]) / 2, "q3": v[4], "max": v[5]} for c, v in got.items() if v}


def box_by_category(df: DataFrame, number: str, category: str, groups: int = BOX_GROUPS) -> DataFrame:
    """Count, mean, least and greatest of ``number`` for the most frequent values of ``category``."""
    stats = df.groupBy(col(category).alias("category")).agg(F.count("*").alias("n"), F.avg(present(df, number)).alias("mean"), F.min(present(df, number)).alias("min"), F.max(present(df, number)).alias("max"))
    return stats.orderBy(F.desc("n"), "category").limit(groups)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """``a``, ``b`` and ``count`` for pairs of the most frequent values of either column."""
    left = value_counts(df, a, BOX_GROUPS).select(F.col("value").alias("__a"))
    right = value_counts(df, b, CROSS_GROUPS).select(F.col("value").alias("__b"))
    pairs = df.groupBy(col(a).alias("a"), col(b).alias("b")).agg(F.count("*").alias("count"))
    return pairs.join(F.broadcast(left), F.col("a") == F.col("__a"), "left_semi").join(F.broadcast(right), F.col("b") == F.col("__b"), "left_semi")


def scatter_sample(df: DataFrame, x: str, y: str, colour: str | None = None, rows: int = SCATTER_ROWS, seed: int = 42) -> DataFrame:
    """A seeded sample of about ``rows`` points for a plot."""
    n = df.count()
    return df.sample(min(1.0, rows / n), seed).select(*[col(c) for c in (x, y, colour) if c]) if n else df.select(col(x), col(y))


def kpis(df: DataFrame) -> dict[str, float]:
    """Rows, columns, number and string columns, share of missing cells, members of groups of equal rows."""
    rows, nulls = null_counts(df, df.columns)
    cells = rows * len(df.columns) or 1
    return {"rows": rows, "columns": len(df.columns), "numeric": len(core_numeric(df)), "categorical": len(strings(df)), "missing": sum(nulls.values()) / cells, "duplicates": duplicate_count(df)}


def quality_issues(df: DataFrame) -> list[dict]:
    """Findings by nine rules, the severe ones first: ``severity``, ``rule``, ``column`` and ``value``."""
    found: list[tuple[str, str, str | None, float]] = []
    numbers, texts = core_numeric(df), strings(df)
    rows, nulls = null_counts(df, df.columns)
    n = rows or 1
    for c in df.columns:
        if nulls[c]:
            share = nulls[c] / n
            found.append(("high" if share > 0.3 else "medium" if share > 0.05 else "low", "missing", c, share))
    duplicates = duplicate_count(df)
    if duplicates:
        found.append(("high" if duplicates / n > 0.05 else "medium", "duplicate_rows", None, float(duplicates)))
    _, distinct = distinct_counts(df, df.columns)
    found += [("medium", "constant", c, float(distinct[c])) for c in df.columns if distinct[c] <= 1]
    found += [("low", "identifier", c, distinct[c] / n) for c in df.columns if distinct[c] / n > 0.95 and rows > 10]
    fences = iqr_fences(df, numbers)
    exprs: dict = {}
    for c in numbers:
        x = present(df, c)
        exprs[("n", c)] = F.count(x)
        exprs[("out", c)] = F.count(F.when((x < fences[c][0]) | (x > fences[c][1]), 1)) if fences[c] else F.lit(0)
        exprs[("neg", c)] = F.count(F.when(x < 0, 1))
    for c in texts:
        exprs[("space", c)] = F.count(F.when(col(c) != text.normalize_whitespace(col(c)), 1))
        exprs[("all", c)] = F.count_distinct(col(c))
        exprs[("low", c)] = F.count_distinct(F.lower(col(c)))
    got = {}
    keys = list(exprs)
    for k in range(0, len(keys), 16):
        got |= first_row(df, {key: exprs[key] for key in keys[k : k + 16]})
    for c in numbers:
        if got[("n", c)] >= 8 and got[("out", c)]:
            share = got[("out", c)] / got[("n", c)]
            found.append(("high" if share > 0.1 else "medium" if share > 0.02 else "low", "outliers", c, float(got[("out", c)])))
    found += [("low", "negative", c, float(got[("neg", c)])) for c in numbers if got[("neg", c)]]
    found += [("low", "skewed", c, v) for c, v in skewnesses(df, numbers).items() if v is not None and abs(v) > 1]
    found += [("low", "whitespace", c, float(got[("space", c)])) for c in texts if got[("space", c)]]
    found += [("medium", "casing", c, float(got[("all", c)] - got[("low", c)])) for c in texts if got[("all", c)] > got[("low", c)]]
    rank = {"high": 0, "medium": 1, "low": 2}
    return [dict(zip(("severity", "rule", "column", "value"), f)) for f in sorted(found, key=lambda f: rank[f[0]])]


def preview(df: DataFrame, rows: int = PREVIEW, order_by: str | None = None) -> DataFrame:
    return (df.orderBy(col(order_by)) if order_by else df).limit(rows)


def _table(head: list[str], rows: list) -> str:
    cell = lambda v: f"{v:.4g}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["<tr>" + "".join(f"<th>{markup.escape(h)}</th>" for h in head) + "</tr>"]
    lines += ["<tr>" + "".join(f"<td>{markup.escape(cell(v))}</td>" for v in r) + "</tr>" for r in rows]
    return "<table>" + "".join(lines) + "</table>"


def _bars(pairs: list[tuple[str, float]]) -> str:
    """A bar chart as inline SVG."""
    top = max((v for _, v in pairs), default=0) or 1
    bars = [f'<rect x="160" y="{18 * i}" width="{320 * v / top:.1f}" height="14"/><text x="155" y="{18 * i + 11}" text-anchor="end">{markup.escape(str(k)[:24])}</text><text x="{165 + 320 * v / top:.1f}" y="{18 * i + 11}">{v:.6g}</text>' for i, (k, v) in enumerate(pairs)]
    return f'<svg width="600" height="{18 * len(pairs) + 4}">{"".join(bars)}</svg>'


def generate_dashboard(df: DataFrame | None, filename: str | None = None, background_image_path: str | None = None) -> str:
    """The report as HTML (also written to ``output/eda`` under ``filename``): key figures, findings, distributions, preview."""
    if df is None:
        raise ValueError("there is no table to report on")
    numbers, texts = core_numeric(df), strings(df)
    parts = ["<h2>Key figures</h2>", _table(["figure", "value"], list(kpis(df).items()))]
    parts += ["<h2>Findings</h2>", _table(["severity", "rule", "column", "value"], [tuple(i.values()) for i in quality_issues(df)])]
    for c in texts:
        parts += [f"<h3>{markup.escape(c)}</h3>", _bars([(r["value"], float(r["count"])) for r in value_counts(df, c).collect()])]
    boxes = five_numbers(df, numbers)
    for c in numbers:
        parts += [f"<h3>{markup.escape(c)}</h3>", _bars([(f"{r.low:.4g}", float(r["count"])) for r in histogram(df, c).orderBy("bin").collect()]), _table(list(boxes.get(c, {})), [list(boxes.get(c, {}).values())])]
    if len(numbers) > 1:
        parts += ["<h2>Correlations</h2>", _table(["a", "b", "corr"], [(a, b, v) for (a, b), v in correlations(df, numbers).items()])]
    parts += ["<h2>Preview</h2>", _table(df.columns, [list(r) for r in preview(df).collect()])]
    back = f"body{{background-image:url('{markup.escape(background_image_path)}')}}" if background_image_path else ""
    style = f"<style>body{{font-family:sans-serif}}td,th{{padding:2px 8px;text-align:left}}rect{{fill:#47a}}text{{font-size:11px}}{back}</style>"
    page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Data profile</title>{style}</head><body>{''.join(parts)}</body></html>"
    if filename:
        save_dashboard(page, filename)
    return page


def quality_issue_table(df: DataFrame) -> DataFrame:
    rows = [(i["severity"], i["rule"], i["column"], float(i["value"])) for i in quality_issues(df)]
    return df.sparkSession.createDataFrame(rows, "severity string, rule string, column string, value double")


