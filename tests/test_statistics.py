import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import millrace as mr
from millrace.operators import outliers
from millrace.functions import stats
from millrace.operators import eda


def nearest(values, q):
    v = sorted(values)
    return v[int(math.floor(q * (len(v) - 1) + 0.5))]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y), None if i % 10 == 0 else float(x * 0.9 + 1e-3 * y)) for i, (x, y) in enumerate(zip(rng.lognormal(size=600), rng.normal(size=600)))]
    return spark.createDataFrame(rows, "id int, x double, y double, z double").repartition(5)


def test_order_statistics_both_ways(numbers):
    x = [r.x for r in numbers.collect()]
    for direct in (10_000, 10):
        got = stats.order_statistics(numbers, {"x": lambda n: [stats.nearest_rank(q, n) for q in (0, 0.05, 0.25, 0.5, 0.95, 1)]}, direct)["x"]
        assert got == [nearest(x, q) for q in (0, 0.05, 0.25, 0.5, 0.95, 1)]


def test_quantile_ignores_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (float("nan"),), (None,)], "x double")
    assert stats.quantiles(df, ["x"], [0.25, 0.75])["x"] == [2.0, 3.0]
    assert stats.medians(df, ["x"])["x"] == 2.5
    assert stats.iqr_fences(df.where("x is null"), ["x"]) == {"x": None}


def test_outlier_filters(spark, numbers):
    clean = mr.remove_outliers(numbers.select("x", "y"))
    left = [(r.x, r.y) for r in numbers.collect()]
    for k in (0, 1):
        q1, q3 = (nearest([r[k] for r in left], q) for q in (0.25, 0.75))
        left = [r for r in left if q1 - 1.5 * (q3 - q1) <= r[k] <= q3 + 1.5 * (q3 - q1)]
    assert sorted((r.x, r.y) for r in clean.collect()) == sorted(left)
    empty = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert mr.remove_outliers(empty).count() == 2 and mr.remove_outliers(empty, strict_compat=True).count() == 0
    one = spark.createDataFrame([(1.0,)], "a double")
    assert mr.remove_outliers_zscore(one).count() == 1 and mr.remove_outliers_mad(one).count() == 1


def test_group_outliers_do_not_depend_on_partitions(spark):
    rows = [("a" if i % 2 else None, float(i % 17) if i % 50 else 999.0) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x double")
    one, many = (sorted(map(str, mr.remove_outliers_by_group(df.repartition(n), "g").collect())) for n in (1, 7))
    assert one == many and "999" not in str(one) and "None" in str(one)


def test_winsorize_keeps_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "x double")
    got = [r.x for r in mr.winsorize(df).collect()]
    assert got[-1] is None and min(x for x in got if x is not None) == 5.0 and max(x for x in got if x is not None) == 94.0


def test_skewness_and_log(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (100.0, 5.0)] + [(1.5, 5.0)] * 10, "x double, c double")
    x = np.array([1, 2, 100] + [1.5] * 10)
    m = x - x.mean()
    got = mr.check_skewness(df)
    assert got["x"] == pytest.approx((m**3).mean() / (m**2).mean() ** 1.5) and math.isnan(got["c"])
    assert mr.fix_skewness(df).first().x == pytest.approx(math.log1p(1.0))


def test_collinearity(spark, numbers):
    assert mr.collinear_to_drop(numbers.select("x", "y", "z")) == ["z"]
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert mr.check_multicollinearity(constant).columns == ["a", "b"]
    matrix = {(r.a, r.b): r["corr"] for r in mr.correlation_matrix(numbers, ["x", "z"]).collect()}
    assert matrix[("x", "x")] == 1.0 and matrix[("x", "z")] == pytest.approx(matrix[("z", "x")])


def test_scaling_and_bins(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(1, 11)] + [(None, 1.0)], "x double, c double")
    assert {r.c for r in mr.scale_numeric(df, "standard").collect()} == {1.0}
    assert max(r.x for r in mr.scale_numeric(df, "minmax").collect() if r.x is not None) == 1.0
    with pytest.raises(ValueError):
        mr.scale_numeric(df, "other")
    out = mr.bin_numeric(df, ["x"], 2)
    assert {r.x_bin for r in out.collect()} == {"(-inf, 6]", "(6, inf]", None}
    assert {r.x_bin for r in mr.bin_numeric(df, ["x", "c"], 3, "uniform").collect()} == {"(-inf, 4]", "(4, 7]", "(7, inf]", None}


def test_isolation_forest_drops_the_planted_row(spark, numbers):
    planted = numbers.select("x", "y").union(spark.createDataFrame([(500.0, 90.0)], "x double, y double"))
    kept = mr.remove_outliers_isolation_forest(planted, 0.05)
    assert kept.where("x = 500").count() == 0 and abs(kept.count() / 601 - 0.95) < 0.02


def test_quality_issues(spark):
    rows = [(i, None if i < 8 else "A" if i % 2 else "a", " x" if i == 3 else "x", float(i % 5) if i else -100.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, cat string, sp string, v double")
    found = {(i["rule"], i["column"]): i["severity"] for i in mr.quality_issues(df)}
    assert found[("missing", "cat")] == "high" and found[("identifier", "id")] == "low" and found[("outliers", "v")] == "medium"
    assert found[("negative", "v")] == found[("skewed", "v")] == found[("whitespace", "sp")] == "low" and found[("casing", "cat")] == "medium"
    assert [i["severity"] for i in mr.quality_issues(df)] == sorted((i["severity"] for i in mr.quality_issues(df)), key=["high", "medium", "low"].index)


def test_dashboard(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    df = spark.createDataFrame([(1, "<a>", 2.0), (2, "b", 3.0)], "id long, s string, v double")
    page = mr.generate_dashboard(df, "report.html")
    assert "&lt;a&gt;" in page and (tmp_path / "output/eda/report.html").exists()
    with pytest.raises(ValueError):
        mr.generate_dashboard(None)
    assert eda.kpis(df)["rows"] == 2 and eda.crosstab(df, "s", "id").count() == 2 and eda.box_by_category(df, "v", "s").count() == 2


def test_isolation_forest_samples_rows_not_values(spark, monkeypatch):
    """Three values over 40,000 rows: each is in the samples as often as in the rows."""
    from millrace.operators import iforest

    seen = []
    tree = iforest._tree
    monkeypatch.setattr(iforest, "_tree", lambda x, rng, limit: seen.append(x) or tree(x, rng, limit))
    rows = spark.range(40_000).selectExpr("CASE WHEN id % 10 < 6 THEN 1.0D WHEN id % 10 < 9 THEN 2.0D ELSE 50.0D END AS x")
    iforest.remove_outliers_isolation_forest(rows, 0.05).count()
    sampled = [v for x in seen for v in x[:, 0]]
    assert [sampled.count(v) / len(sampled) for v in (1.0, 2.0, 50.0)] == pytest.approx([0.6, 0.3, 0.1], abs=0.05)


def test_large_groups_are_bracketed_exactly(spark, monkeypatch):
    """With a coarse approximation the brackets differ from all values, and the fences do not."""
    monkeypatch.setattr(outliers, "ACCURACY", 50)
    rng = np.random.default_rng(7)
    rows = [("a", float(v)) for v in rng.lognormal(size=3000).round(2)] + [("b", 1.0)] * 500 + [("b", 9.0)] * 20 + [(None, float(k)) for k in range(60)] + [("c", None), ("d", 5.0)]
    got = mr.remove_outliers_by_group(spark.createDataFrame(rows, "g string, x double"), "g", ["x"]).collect()
    want = []
    for g in {r[0] for r in rows}:
        own = sorted(v for k, v in rows if k == g and v is not None)
        if own:
            q1, q3 = (own[int(np.floor(q * (len(own) - 1) + 0.5))] for q in (0.25, 0.75))
            want += [(g, v) for v in own if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(got) < len(rows)


def test_ranks_taken_together_are_values(spark):
    ranks = [(r, n) for n in (1, 2, 50, 997) for r in range(n)]
    assert all(stats._share(r, n) is None or stats._share(r, n) * (n - 1) == r for r, n in ranks)
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 997):
        values = np.sort(np.round(rng.normal(size=n), 1 + n % 3))
        df = spark.createDataFrame([(float(v),) for v in rng.permutation(values)], "x double")
        assert stats.order_statistics(df, {"x": lambda k: list(range(k))})["x"] == values.tolist()


def test_one_summary_a_column_for_all_ranks(spark, monkeypatch):
    """Five numbers of large columns: one approximate summary a column, none for the least and the greatest, and exact results."""
    rows = [(float(x * 7919 % 1009), x % 13) for x in range(3000)]
    df = spark.createDataFrame(rows, "x double, n long")
    want = eda.five_numbers(df, ["x", "n"])
    asked = []
    approx = F.percentile_approx
    monkeypatch.setattr(stats, "DIRECT_ROWS", 10)
    monkeypatch.setattr(stats.F, "percentile_approx", lambda *a: asked.append(a) or approx(*a))
    assert eda.five_numbers(df, ["x", "n"]) == want and len(asked) == 2
    assert (want["x"]["min"], want["x"]["max"]) == (0.0, 1008.0)


def test_fences_of_few_groups_are_broadcast(spark):
    """The rows of a group do not meet by its key, whatever Spark thinks of the sizes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mr.remove_outliers_by_group(spark.createDataFrame([("a", float(x)) for x in range(50)] + [("b", 1.0), ("b", 900.0)], "g string, x double"), "g", ["x"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and out.count() == 52
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
