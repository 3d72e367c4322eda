import json
import math

import pytest

import millrace as mr
from millrace.functions import text
from millrace.operators.columns import snake_case
from pyspark.sql import functions as F
from pyspark.sql import types as T


def values(df, c):
    return [r[c] for r in df.collect()]


def test_snake_case_and_collisions(spark):
    assert [snake_case(x) for x in (" camelCase ", "Full Name!", "__a  b__", "!!")] == ["camel_case", "full_name", "a_b", "column"]
    df = spark.createDataFrame([(1, 2, 3)], ["Full Name", "fullName", "full_name"])
    out = mr.standardize_column_names(df).columns
    assert out == ["full_name", "full_name_1", "full_name_2"]
    assert mr.standardize_column_names(spark.createDataFrame([(1,)], out[:1])).columns == ["full_name"]


def test_empty_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, None), (None, None, "x"), (None, None, None)], "a int, b int, c string")
    out = mr.drop_empty_rows_and_columns(df)
    assert out.columns == ["a", "c"] and out.count() == 2
    assert mr.drop_empty_rows_and_columns(df.limit(0)).columns == ["a", "b", "c"]


def test_duplicate_columns(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1, nan, nan, "1"), (2, 2, 1.0, 1.0, "2")], "a int, b int, c double, d double, e string")
    assert mr.remove_duplicate_columns(df).columns == ["a", "c", "d", "e"]
    nulls = spark.createDataFrame([(None, None), (1, 1)], "a int, b int")
    assert mr.remove_duplicate_columns(nulls).columns == ["a"]


def test_id_like_and_high_missing(spark):
    df = spark.createDataFrame([(i, i % 3, None if i % 2 else i) for i in range(100)], "user_id int, g int, h int")
    assert mr.drop_id_like_columns(df).columns == ["g", "h"]
    assert mr.drop_high_missing_columns(df, 0.4).columns == ["user_id", "g"]
    assert mr.drop_high_missing_columns(df, 0.5).columns == ["user_id", "g", "h"]


def test_unicode_strings(spark):
    rows = [(" a  b \n",), (None,), ("",), ("ﬁx\u0085\ty​",), ("CafÃ©",), ("é",), ("日本 Ã©",)]
    df = spark.createDataFrame(rows, "s string")
    assert values(mr.normalize_whitespace(df), "s")[:3] == ["a b", None, ""]
    assert values(mr.normalize_unicode(df), "s")[3] == "fixy​"
    assert values(mr.fix_mojibake(df), "s")[4:] == ["Café", "é", "日本 Ã©"]
    once = mr.normalize_unicode(mr.normalize_whitespace(df))
    assert values(once, "s") == values(mr.normalize_unicode(mr.normalize_whitespace(once)), "s")


def test_casing(spark):
    df = spark.createDataFrame([("o'neil-smith x2y",), (None,)], "s string")
    assert values(mr.standardize_casing(df, {"s": "title"}), "s") == ["O'Neil-Smith X2y", None]
    assert values(mr.standardize_casing(df, {"s": "other"}), "s")[0] == "o'neil-smith x2y"


def test_symbols(spark):
    df = spark.createDataFrame([("$1,000", "a"), ("-5", "b"), ("₹2,500", "•c"), (None, None)], "m string, t string")
    out = mr.replace_symbols(df)
    assert values(out, "m") == ["1000", "5", "2500", None] and values(out, "t") == ["a", "b", "•c", None]
    assert values(mr.replace_symbols_and_convert_to_float(df), "m") == [1000.0, -5.0, 2500.0, None]
    assert values(mr.replace_symbols_and_convert_to_float(df, strict_compat=True), "m") == [1000.0, 5.0, 2500.0, None]
    words = spark.createDataFrame([("New-York",), ("Paris",)], "s string")
    assert values(mr.replace_symbols_and_convert_to_float(words), "s") == ["New-York", "Paris"]


def test_preprocess_golden(spark):
    s = "I can't wait!! Visit https://x.co @bob \U0001f600 it's GR8"
    df = spark.createDataFrame([(s,), (None,), ("idk &amp; 中文 ok",)], "s string")
    assert values(df.select(mr.preprocess_text(F.col("s")).alias("s")), "s") == ["cannot wait visit", "", "know amp ok"]
    kept = df.select(mr.preprocess_text(F.col("s"), remove_stopwords=False, url_mode="token", emoji_only=True).alias("s"))
    assert values(kept, "s")[0] == "i cannot wait visit it is gr8" and "中文" in values(kept, "s")[2]


def test_number_guard(spark):
    df = spark.createDataFrame([(x,) for x in ("1d", "5f", "Infinity", "NaN", " 1e3 ", ".5", "-2.", "")], "s string")
    got = values(df.select(text.number(F.col("s")).alias("n")), "n")
    assert got == [None, None, None, None, 1000.0, 0.5, -2.0, None]
    assert all(x is None or math.isfinite(x) for x in got)


def test_coerce_and_suggest(spark):
    df = spark.createDataFrame([("1", "x", "a"), ("2", "3", "b")], "n string, m string, colour string")
    assert dict(mr.coerce_numeric(df).dtypes) == {"n": "double", "m": "string", "colour": "string"}
    assert mr.suggest_column_names(df, ["color"]) == {"colour": "color"}
    assert mr.fix_spelling_errors_in_columns(df, {"colour": "color", "zzz": "q"}).columns == ["n", "m", "color"]


def test_negatives(spark):
    df = spark.createDataFrame([(-1, -2.5, "x"), (3, None, "y")], "a long, b double, c string")
    assert [tuple(r) for r in mr.handle_negative_values(df).collect()] == [(1, 2.5, "x"), (3, None, "y")]


@pytest.mark.parametrize("size", ["1k", "97", "128m"])
def test_json_arrays_are_read_in_parts(spark, tmp_path, size):
    """Any file of records in any layout, cut into ranges of any size, gives what one task that reads it whole gives."""
    tricky = [
        {"id": i, "s": ['a}"b', "{[", "\\\\", 'q\\"}', "é日\n}{", ""][i % 6], "o": {"x": [{"y": f"[{i}"}, {"y": "}"}], "e": {}}, "n": None if i % 3 else i / 4} for i in range(200)
    ]
    layouts = {
        "minified.json": json.dumps(tricky, separators=(",", ":"), ensure_ascii=False),
        "indented.json": "\ufeff  " + json.dumps(tricky, indent=3) + "\n\n",
        "one.json": json.dumps(tricky[1], indent=1),
        "none.json": " [ ]\n",
    }
    schema = T.StructType.fromDDL("id long, n double, o struct<e: struct<z: int>, x: array<struct<y: string>>>, s string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for name, content in layouts.items():
        path = tmp_path / name
        path.write_text(content, encoding="utf-8")
        whole = sorted(map(str, spark.read.option("multiLine", True).schema(schema).json(str(path)).collect()))
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = mr.load_data(str(path), spark, schema).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
            spark.conf.set("spark.sql.files.openCostInBytes", before[1])
        assert sorted(map(str, got)) == whole, name
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(json.dumps(r) for r in tricky), encoding="utf-8")
    assert sorted((r.id, r.s) for r in mr.load_data(str(lines), spark).collect()) == sorted((r["id"], r["s"]) for r in tricky)
