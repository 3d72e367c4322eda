import os

import duckdb
import pytest

import __spark_entry__ as entry_point
import millrace as mr
from millrace.plans import catalogue
from millrace.streaming.steps import apply_steps, clean_stream

DATA = "/root/testdata/sf0.001"


def test_reading_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,day,x\n1,2024-01-05,1.5\n2,2024-02-06,\n")
    (tmp_path / "a.tsv").write_text("id\tday\n1\t2024-01-05\n")
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"}, {"a": 2}]')
    csv = mr.load_data(str(tmp_path / "a.csv"), spark)
    assert dict(csv.dtypes) == {"id": "bigint", "day": "date", "x": "double"}
    assert dict(mr.load_data(str(tmp_path / "a.tsv"), spark).dtypes) == {"id": "bigint", "day": "string"}
    assert mr.load_data(str(tmp_path / "a.json"), spark).count() == 2
    for bad in ("a.xlsx", "a.txt", "a.CSV"):
        with pytest.raises(ValueError):
            mr.load_data(bad, spark)
    out = mr.save_cleaned_data(csv, str(tmp_path / "out.csv"), single_file=True)
    assert dict(out.dtypes) == {"id": "int", "day": "date", "x": "float"}
    assert spark.read.option("header", True).csv(str(tmp_path / "out.csv")).count() == 2


def test_pipeline_on_a_mixed_table(spark, tmp_path):
    rows = [(i, ["male", "female"][i % 2], None if i % 7 == 0 else 20.0 + i % 40, float(i % 13) ** 3, None if i % 3 else "C85", i % 5 == 0 and 1 or 0) for i in range(140)]
    df = spark.createDataFrame(rows, "id long, sex string, age double, fare double, cabin string, survived long")
    config = mr.CleanConfig(target="survived", balance="under", output=str(tmp_path / "c.parquet"))
    run = mr.Pipeline(config)
    out = run.run(df)
    assert out.where("age is null").count() == 0 and run.reports["column_types"]["sex"]["type"] == "categorical"
    counts = {r["survived"]: r["count"] for r in out.groupBy("survived").count().collect()}
    assert len(set(counts.values())) == 1
    assert spark.read.parquet(str(tmp_path / "c.parquet")).count() == out.count()
    assert mr.clean_data(df.select("id", "age")).count() == 140


def test_flagship(spark):
    assert entry_point.entry(spark).count() > 0


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    for name in ("remove_outliers_sequential", "outliers_by_group", "preprocess_text", "canonical_urls", "impute_interpolate", "encode_label", "bin_quantile", "detect_language", "correct_spelling", "csv_round_trip", "parquet_round_trip"):
        got = catalogue.QUERIES[name](spark, DATA)
        want = con.sql(catalogue.ORACLES[name])
        order = sorted(got.columns)
        clean = lambda rows: sorted((tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
        assert clean(map(tuple, got.select(*order).collect())) == clean(want.select(*[f'"{c}"' for c in order]).fetchall()), name


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    df = spark.createDataFrame([(1, " A  b ", "yes"), (2, None, "no"), (2, "again", "no")], "id long, s string, f string")
    df.selectExpr("*", "timestamp'2024-01-01 00:00:00' AS ts").write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    steps = [("normalize_whitespace", {"columns": ["s"]}), ("normalize_booleans", {"columns": ["f"]})]
    query = clean_stream(stream, steps, str(tmp_path / "out"), str(tmp_path / "cp"), watermark=("ts", "1 hour"), deduplicate=["id"])
    query.awaitTermination(120)
    out = {r.id: (r.s, r.f) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out[1] == ("A b", True) and set(out) == {1, 2}
    with pytest.raises(ValueError):
        apply_steps(df, [("scale_numeric", {})])
    with pytest.raises(ValueError):
        apply_steps(df, [("normalize_booleans", {})])
