"""Registered queries over the sample tables and the SQL that checks them.

Every query runs a step of the library over a whole table. Computed floats are rounded on both sides, since sums are added in
different orders. Steps whose result SQL cannot state (iterative or greedy ones) have no SQL here; tests cover them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import millrace as mr
from millrace.functions import numbering, text
from millrace.functions.selectors import col
from millrace.functions.stats import correlations, iqr_fences, skewnesses
from millrace.functions.storage import shared_dir
from millrace.functions.words import CONTRACTIONS, FORMATS, STOPWORDS
from millrace.operators import eda, pii
from millrace.plans.pipeline import CleanConfig, Pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query and, if there is one, its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem through the cleaning pipeline with outlier removal, then scaled."""
    config = CleanConfig(process_text=False, expand_json=False, symbols_to_float=False, strip_symbols=False, mask_pii=False, remove_outliers=True, collinearity=0.9)
    return mr.scale_numeric(Pipeline(config).run(table(spark, sf_dir, "lineitem")), "standard", ["l_extendedprice", "l_discount"])


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(col(c).cast("double"), digits) if c in columns else col(c)).alias(c) for c in df.columns])


def rank(x: str, q: str) -> str:
    """SQL for the nearest-rank quantile of a column as an aggregate."""
    return f"list_sort(list({x}))[1 + CAST(floor(CAST({q} AS DOUBLE) * (count({x}) - 1) + 0.5) AS BIGINT)]"


def fences(x: str, source: str, name: str) -> str:
    """SQL for a table of one row with the fences of ``x``."""
    return f"{name} AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT {rank(x, '0.25')} AS q1, {rank(x, '0.75')} AS q3 FROM {source}))"


LINE = "l_orderkey, l_linenumber"

# reading and writing ------------------------------------------------------------------------------------------------


def new_path(spark: SparkSession, suffix: str) -> str:
    """A new place in the folder that all executors share."""
    return f"{shared_dir(spark)}/round-trip-{uuid.uuid4().hex}{suffix}"


def round_trip(spark: SparkSession, df: DataFrame, suffix: str, quantize: bool = False) -> DataFrame:
    """``df`` written and read back."""
    path = new_path(spark, suffix)
    mr.save_cleaned_data(df, path, quantize)
    return mr.load_data(path, spark)


@query("csv_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, 'date' AS kind FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"))
    back = round_trip(spark, df, ".csv")
    return back.withColumn("kind", F.lit(dict(back.dtypes)["o_orderdate"])).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("parquet_round_trip", "SELECT CAST(o_orderkey AS INT) AS o_orderkey, o_orderpriority, CAST(o_totalprice AS FLOAT) AS o_totalprice FROM orders")
def _(spark, sf):
    return round_trip(spark, table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ".parquet", quantize=True)


@query("tsv_input", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, sf):
    path = new_path(spark, ".tsv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).option("sep", "\t").csv(path)
    return mr.load_data(path, spark)


@query("json_input", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations")
def _(spark, sf):
    path = new_path(spark, ".json")
    table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").write.option("ignoreNullFields", False).json(path)
    return mr.load_data(path, spark)


# outliers -----------------------------------------------------------------------------------------------------------


#: A long-tailed price, so that fences cut something off.
_TAIL = "(l_extendedprice * l_extendedprice / 1000000e0) * (l_extendedprice * l_extendedprice / 1000000e0)"


@query("iqr_filter_extendedprice", f"WITH t AS (SELECT {LINE}, {_TAIL} AS tail FROM lineitem), {fences('tail', 't', 'f')} SELECT {LINE}, tail FROM t, f WHERE tail BETWEEN lo AND hi")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("int").alias("l_orderkey"), "l_linenumber", F.expr(_TAIL).alias("tail"))
    return mr.remove_outliers(df).withColumn("l_orderkey", F.col("l_orderkey").cast("long"))


@query("iqr_bounds_orders", f"WITH {fences('o_totalprice', 'orders', 'f')} SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM f")
def _(spark, sf):
    lo, hi = iqr_fences(table(spark, sf, "orders"), ["o_totalprice"])["o_totalprice"]
    return spark.createDataFrame([(lo, hi)], "lo double, hi double").select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(
    "remove_outliers_sequential",
    f"WITH t0 AS (SELECT *, {_TAIL} AS tail FROM lineitem), {fences('l_quantity', 't0', 'f1')}, t1 AS (SELECT t0.* FROM t0, f1 WHERE l_quantity BETWEEN lo AND hi), {fences('tail', 't1', 'f2')}, "
    f"t2 AS (SELECT t1.* FROM t1, f2 WHERE tail BETWEEN lo AND hi), {fences('l_discount', 't2', 'f3')} SELECT {LINE}, l_quantity, tail, l_discount FROM t2, f3 WHERE l_discount BETWEEN lo AND hi",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("l_orderkey"), "l_linenumber", "l_quantity", F.expr(_TAIL).alias("tail"), "l_discount")
    return mr.remove_outliers(df).withColumn("l_orderkey", F.col("l_orderkey").cast("long"))


_ORDER_TAIL = "(o_totalprice * o_totalprice / 1000000e0) * (o_totalprice * o_totalprice / 1000000e0)"


@query("outlier_rows_orders", f"WITH t AS (SELECT o_orderkey, {_ORDER_TAIL} AS tail FROM orders), {fences('tail', 't', 'f')} SELECT o_orderkey, tail FROM t, f WHERE tail < lo OR tail > hi")
def _(spark, sf):
    return mr.check_outliers(table(spark, sf, "orders").select("o_orderkey", F.expr(_ORDER_TAIL).alias("tail")))["tail"].select("o_orderkey", "tail")


@query("zscore_filter", "WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS d FROM customer) SELECT c_custkey, c_acctbal FROM customer, s WHERE abs((c_acctbal - m) / d) <= 1.5")
def _(spark, sf):
    return mr.remove_outliers_zscore(table(spark, sf, "customer"), 1.5, ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query("mad_filter", "WITH m AS (SELECT median(value) AS m FROM events), d AS (SELECT median(abs(value - m)) AS d FROM events, m) SELECT event_id, value FROM events, m, d WHERE abs(CAST(0.6745 AS DOUBLE) * (value - m) / d) <= 1.2")
def _(spark, sf):
    return mr.remove_outliers_mad(table(spark, sf, "events"), 1.2, ["value"]).select("event_id", "value")


@query("winsorize_price", f"WITH q AS (SELECT {rank('p_retailprice', '0.05')} AS lo, {rank('p_retailprice', '0.95')} AS hi FROM part) SELECT p_partkey, least(greatest(p_retailprice, lo), hi) AS p_retailprice FROM part, q")
def _(spark, sf):
    return mr.winsorize(table(spark, sf, "part"), columns=["p_retailprice"]).select("p_partkey", "p_retailprice")


@query(
    "outliers_by_group",
    f"WITH q AS (SELECT l_returnflag AS g, {rank('l_extendedprice', '0.25')} AS q1, {rank('l_extendedprice', '0.75')} AS q3 FROM lineitem GROUP BY 1) SELECT {LINE}, l_returnflag, l_extendedprice FROM lineitem JOIN q ON g = l_returnflag WHERE l_extendedprice BETWEEN q1 - 0.3e0 * (q3 - q1) AND q3 + 0.3e0 * (q3 - q1)",
)
def _(spark, sf):
    return mr.remove_outliers_by_group(table(spark, sf, "lineitem"), "l_returnflag", ["l_extendedprice"], 0.3).select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")


_SKEW = "(avg(power({x} - m, 3)) / power(avg(power({x} - m, 2)), 1.5))"


@query("skewness_report", " UNION ALL ".join(f"SELECT '{x}' AS name, round({_SKEW.format(x=x)}, 6) AS skewness FROM lineitem, (SELECT avg({x}) AS m FROM lineitem)" for x in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def _(spark, sf):
    got = skewnesses(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return spark.createDataFrame(list(got.items()), "name string, skewness double").select("name", F.round("skewness", 6).alias("skewness"))


@query("fix_skewness", f"WITH k AS (SELECT {_SKEW.format(x='value')} AS s FROM events, (SELECT avg(value) AS m FROM events)) SELECT event_id, round(CASE WHEN s > 1 THEN ln(value + 1) ELSE value END, 6) AS value FROM events, k")
def _(spark, sf):
    return rounded(mr.fix_skewness(table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), "value")).withColumn("event_id", F.col("event_id").cast("long")), ["value"])


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_pairs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for j, b in enumerate(_NUMBERS) for a in _NUMBERS[:j]))
def _(spark, sf):
    got = correlations(table(spark, sf, "lineitem"), _NUMBERS)
    return spark.createDataFrame([(a, b, v) for (a, b), v in got.items()], "a string, b string, corr double").select("a", "b", F.round("corr", 6).alias("corr"))


@query("collinear_drop", f"SELECT {LINE}, l_quantity, l_discount, l_tax FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("l_orderkey"), "l_linenumber", "l_quantity", (F.col("l_quantity") * 0.9).alias("scaled"), "l_discount", "l_tax")
    return mr.check_multicollinearity(df, 0.7).withColumn("l_orderkey", F.col("l_orderkey").cast("long"))


# strings ------------------------------------------------------------------------------------------------------------


@query("abs_negative_balance", "SELECT c_custkey, abs(c_acctbal) AS c_acctbal FROM customer")
def _(spark, sf):
    return mr.handle_negative_values(table(spark, sf, "customer")).select("c_custkey", "c_acctbal")


@query("strip_symbols_priority", "SELECT o_orderkey, translate(o_orderpriority, '$₹,-•', '') AS o_orderpriority FROM orders")
def _(spark, sf):
    return mr.replace_symbols(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"))


@query("symbols_to_float", "SELECT o_orderkey, o_totalprice AS price FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("$"), F.col("o_totalprice").cast("string")).alias("price"))
    return mr.replace_symbols_and_convert_to_float(df)


_SQUEEZE = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("normalize_whitespace", f"SELECT conv_id, turn, {_SQUEEZE.format(x='text')} AS text FROM conversations")
def _(spark, sf):
    return mr.normalize_whitespace(table(spark, sf, "conversations").select("conv_id", "turn", "text"))


@query("normalize_whitespace_documents", f"SELECT doc_id, {_SQUEEZE.format(x='text')} AS text FROM documents")
def _(spark, sf):
    return mr.normalize_whitespace(table(spark, sf, "documents").select("doc_id", "text"))


@query("normalize_unicode", "SELECT doc_id, regexp_replace(nfc_normalize(text), '[\\x00-\\x1f\\x7f]', '', 'g') AS text FROM documents")
def _(spark, sf):
    return mr.normalize_unicode(table(spark, sf, "documents").select("doc_id", "text"))


@query("fix_mojibake", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    broken = F.encode("text", "UTF-8")
    df = table(spark, sf, "documents").select("doc_id", "text").where(F.col("text").rlike("^[\\x{00}-\\x{FF}]*$"))
    rest = table(spark, sf, "documents").select("doc_id", "text").where(~F.col("text").rlike("^[\\x{00}-\\x{FF}]*$"))
    return mr.fix_mojibake(df.select("doc_id", F.decode(broken, "ISO-8859-1").alias("text"))).unionByName(rest)


@query("standardize_categories", "SELECT p_partkey, lower(trim(p_type)) AS p_type FROM part")
def _(spark, sf):
    return mr.standardize_categories(table(spark, sf, "part").select("p_partkey", "p_type"), ["p_type"])


@query("standardize_casing", "SELECT n_nationkey, upper(n_name) AS n_name, lower(r_name) AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    df = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return mr.standardize_casing(df.select("n_nationkey", "n_name", "r_name"), {"n_name": "upper", "r_name": "lower"})


@query("standardize_casing_title", "SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS c_mktsegment FROM customer")
def _(spark, sf):
    return mr.standardize_casing(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), {"c_mktsegment": "title"})


def _preprocess_sql() -> str:
    """The chain in DuckDB: tokens through the contraction table, patterns in order, stopwords dropped."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    x = "array_to_string(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: coalesce(c[w], w)), ' ')"
    for pattern, to in text.TEXT_STEPS:
        x = f"regexp_replace({x}, {quote(pattern.replace('(?m)', ''))}, '{to}', 'g')"
    table = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in CONTRACTIONS.items()) + "}"
    stop = "[" + ", ".join(map(quote, STOPWORDS)) + "]"
    return f"WITH m AS (SELECT {table} AS c, {stop} AS s) SELECT doc_id, array_to_string(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '' AND NOT list_contains(s, w)), ' ') AS text FROM documents, m"


@query("preprocess_text", _preprocess_sql())
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", mr.preprocess_text(F.col("text")).alias("text"))


# missing values -----------------------------------------------------------------------------------------------------

@query("disguised_missing", "SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN event_type END AS event_type FROM events")
def _(spark, sf):
    kind = F.when(F.col("event_id") % 7 == 0, "N/A").when(F.col("event_id") % 11 == 0, " Unknown ").otherwise(F.col("event_type"))
    return mr.replace_disguised_missing(table(spark, sf, "events").select("event_id", kind.alias("event_type")))


def labelled(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")


_LABELLED = "documents LEFT JOIN labels USING (doc_id)"


@query("missing_indicators", f"SELECT doc_id, CAST(quality AS DOUBLE) AS quality, quality IS NULL AS quality_missing FROM {_LABELLED}")
def _(spark, sf):
    return mr.add_missing_indicators(labelled(spark, sf).select("doc_id", F.col("quality").cast("double").alias("quality")))


@query("impute_mean", f"SELECT doc_id, round(coalesce(CAST(quality AS DOUBLE), avg(quality) OVER ()), 6) AS quality FROM {_LABELLED}")
def _(spark, sf):
    return rounded(mr.impute_missing(labelled(spark, sf), "mean", columns=["quality"]).select("doc_id", "quality"), ["quality"])


@query("impute_median", f"SELECT doc_id, coalesce(CAST(quality AS DOUBLE), (SELECT median(quality) FROM labels JOIN documents USING (doc_id))) AS quality FROM {_LABELLED}")
def _(spark, sf):
    return mr.impute_missing(labelled(spark, sf), "median", columns=["quality"]).select("doc_id", "quality")


@query("impute_constant", f"SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM {_LABELLED}")
def _(spark, sf):
    return mr.impute_missing(labelled(spark, sf), "constant", constant_value=-1).select("doc_id", "quality", "toxic")


@query("impute_mode", "WITH h AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS t FROM events) SELECT event_id, coalesce(t, (SELECT t FROM h WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, t LIMIT 1)) AS event_type FROM h")
def _(spark, sf):
    return mr.impute_missing(table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type")))


def gaps(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


_GAPS = "h AS (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


@query("impute_ffill", f"WITH {_GAPS} SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS value FROM h")
def _(spark, sf):
    return mr.impute_missing(gaps(spark, sf), "ffill", columns=["value"], order_by="event_id", partition_by="user_id")


@query("impute_bfill", f"WITH {_GAPS} SELECT event_id, user_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM h")
def _(spark, sf):
    return mr.impute_missing(gaps(spark, sf), "bfill", columns=["value"], order_by="event_id", partition_by="user_id")


@query(
    "impute_interpolate",
    f"WITH {_GAPS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM h), k AS (SELECT *, CASE WHEN value IS NOT NULL THEN t END AS kt FROM n), "
    "b AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS x0, last_value(kt IGNORE NULLS) OVER w AS t0, first_value(value IGNORE NULLS) OVER v AS x1, first_value(kt IGNORE NULLS) OVER v AS t1 FROM k "
    "WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT event_id, user_id, round(CASE WHEN value IS NOT NULL THEN value WHEN t1 > t0 THEN x0 + (x1 - x0) * (t - t0) / (t1 - t0) END, 6) AS value FROM b",
)
def _(spark, sf):
    return rounded(mr.impute_missing(gaps(spark, sf), "interpolate", columns=["value"], order_by="event_id", partition_by="user_id"), ["value"])


@query(
    "impute_knn",
    "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS price, CAST(p_size AS DOUBLE) AS size FROM part), q AS (SELECT DISTINCT size FROM p WHERE price IS NULL), "
    "r AS (SELECT q.size AS wanted, d.price, row_number() OVER (PARTITION BY q.size ORDER BY abs(d.size - q.size), d.price, d.size) AS k FROM q, p d WHERE d.price IS NOT NULL), "
    "m AS (SELECT wanted, avg(price) AS mean FROM r WHERE k <= 5 GROUP BY wanted) SELECT p_partkey, round(coalesce(price, mean), 6) AS p_retailprice, size AS p_size FROM p LEFT JOIN m ON wanted = size",
)
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("p_retailprice"), F.col("p_size").cast("double").alias("p_size"))
    return rounded(mr.impute_missing(df, "knn", columns=["p_retailprice", "p_size"]), ["p_retailprice"])


@query("impute_mice")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_extendedprice")).alias("l_extendedprice"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax")).alias("l_tax"))
    return rounded(mr.impute_missing(df, "mice", columns=["l_quantity", "l_extendedprice", "l_tax"]), ["l_extendedprice", "l_tax"], 4)


@query(
    "handle_missing_values",
    f"WITH d AS (SELECT lang, n_chars, quality FROM {_LABELLED}), q AS (SELECT DISTINCT n_chars FROM d WHERE quality IS NULL), "
    "r AS (SELECT q.n_chars AS wanted, d.quality, row_number() OVER (PARTITION BY q.n_chars ORDER BY abs(d.n_chars - q.n_chars), d.n_chars, d.quality) AS k FROM q, d WHERE d.quality IS NOT NULL), "
    "m AS (SELECT wanted, avg(quality) AS mean FROM r WHERE k <= 5 GROUP BY wanted) "
    "SELECT coalesce(lang, (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, lang LIMIT 1)) AS lang, CAST(n_chars AS DOUBLE) AS n_chars, round(coalesce(quality, mean), 6) AS quality FROM d LEFT JOIN m ON wanted = n_chars",
)
def _(spark, sf):
    df = labelled(spark, sf).select("lang", F.col("n_chars").cast("double").alias("n_chars"), F.col("quality").cast("double").alias("quality"))
    return rounded(mr.handle_missing_values(df), ["quality"])


_MIXED = "CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS {text}) END"


@query("coerce_numeric", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS mixed, CASE WHEN c_custkey % 2 <> 0 THEN 'n/a' ELSE '7' END AS words FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.expr(_MIXED.format(text="STRING")).alias("mixed"), F.expr("CASE WHEN c_custkey % 2 <> 0 THEN 'n/a' ELSE '7' END").alias("words"))
    return mr.coerce_numeric(df, min_success=0.75)


@query("rename_columns", "SELECT n_nationkey AS nation_key, n_name, n_regionkey AS region_key FROM nation")
def _(spark, sf):
    names = {"n_nationkey": "nation_key", "n_regionkey": "region_key", "n_nmae": "name"}
    return mr.fix_spelling_errors_in_columns(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), names)


@query(
    "data_types",
    "SELECT column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS kind FROM (DESCRIBE customer)",
)
def _(spark, sf):
    df = table(spark, sf, "customer")
    return spark.createDataFrame(list(zip(df.columns, mr.check_data_types(df))), "name string, kind string")


@query("missing_report", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 6) AS share FROM {_LABELLED}" for c in ("doc_id", "quality", "toxic")))
def _(spark, sf):
    return rounded(mr.missing_report(labelled(spark, sf).select("doc_id", "quality", "toxic")), ["share"])


# columns ------------------------------------------------------------------------------------------------------------


@query("standardize_column_names", "SELECT c_custkey AS customer_key, c_name AS full_name, c_acctbal AS full_name_1 FROM customer")
def _(spark, sf):
    return mr.standardize_column_names(table(spark, sf, "customer").select(F.col("c_custkey").alias(" customerKey "), F.col("c_name").alias("Full Name!"), F.col("c_acctbal").alias("full__name")))


@query("drop_high_missing", "SELECT doc_id, lang, n_chars FROM documents")
def _(spark, sf):
    return mr.drop_high_missing_columns(labelled(spark, sf), 0.5)


@query("drop_empty", "SELECT doc_id, CAST(quality AS DOUBLE) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    df = labelled(spark, sf).select("doc_id", F.col("quality").cast("double").alias("quality"), F.lit(None).cast("string").alias("nothing"))
    empty = df.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return mr.drop_empty_rows_and_columns(df.unionByName(empty))


@query("drop_duplicate_columns", "SELECT c_custkey, c_acctbal, c_name FROM customer")
def _(spark, sf):
    return mr.remove_duplicate_columns(table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_custkey").alias("again"), "c_name", F.col("c_name").alias("name_again")))


@query("drop_id_like", "SELECT c_nationkey, c_mktsegment FROM customer")
def _(spark, sf):
    return mr.drop_id_like_columns(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("cardinality", "SELECT 'event_type' AS name, count(DISTINCT event_type) AS n FROM events UNION ALL SELECT 'props', count(DISTINCT props) FROM events")
def _(spark, sf):
    return spark.createDataFrame(list(mr.check_cardinality(table(spark, sf, "events"))[1].items()), "name string, n long")


@query("expand_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def _(spark, sf):
    return mr.fix_json_columns(table(spark, sf, "events").select("event_id", "props"))


@query("column_types", "SELECT 'event_type' AS name, 'categorical' AS type UNION ALL SELECT 'props', 'json'")
def _(spark, sf):
    _, report = mr.detect_column_types_and_process_text(table(spark, sf, "events").select("event_type", "props"))
    return spark.createDataFrame([(c, r["type"]) for c, r in report.items()], "name string, type string")


# types --------------------------------------------------------------------------------------------------------------


@query("parse_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def _(spark, sf):
    return mr.parse_dates(table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"))).withColumn("day", F.col("day").cast("string"))


@query("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS o_orderdate_year, CAST(month(o_orderdate) AS INT) AS o_orderdate_month, CAST(day(o_orderdate) AS INT) AS o_orderdate_day, CAST(isodow(o_orderdate) AS INT) AS o_orderdate_weekday, CAST(quarter(o_orderdate) AS INT) AS o_orderdate_quarter FROM orders")
def _(spark, sf):
    return mr.extract_date_parts(table(spark, sf, "orders").select("o_orderkey", "o_orderdate")).drop("o_orderdate")


@query("normalize_booleans", "SELECT doc_id, quality = 1 AS quality FROM labels")
def _(spark, sf):
    return mr.normalize_booleans(table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, " Yes").otherwise("off").alias("quality")))


@query("downcast", "SELECT p_partkey, CAST(p_size AS TINYINT) AS p_size, CAST(p_retailprice AS FLOAT) AS p_retailprice FROM part")
def _(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_size", "p_retailprice")
    return mr.downcast_numeric(df).withColumn("p_partkey", F.col("p_partkey").cast("long"))


# categories ---------------------------------------------------------------------------------------------------------


@query("rare_categories", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) / count(*) OVER () < 0.04 THEN 'Other' ELSE p_brand END AS p_brand FROM part")
def _(spark, sf):
    return mr.group_rare_categories(table(spark, sf, "part").select("p_partkey", "p_brand"), 0.04, columns=["p_brand"])


@query("value_map", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'tools' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(spark, sf):
    return mr.replace_values(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), {"c_mktsegment": {"BUILDING": "construction", "MACHINERY": "tools"}})


@query("encode_onehot", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS \"o_orderstatus_F\", CAST(o_orderstatus = 'O' AS INT) AS \"o_orderstatus_O\", CAST(o_orderstatus = 'P' AS INT) AS \"o_orderstatus_P\" FROM orders")
def _(spark, sf):
    return mr.encode_categorical(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))


@query("encode_frequency", "SELECT event_id, count(*) OVER (PARTITION BY event_type) AS event_type FROM events")
def _(spark, sf):
    return mr.encode_categorical(table(spark, sf, "events").select("event_id", "event_type"), "frequency")


@query("encode_ordinal", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type FROM events")
def _(spark, sf):
    return mr.encode_categorical(table(spark, sf, "events").select("event_id", "event_type"), "ordinal")


@query("encode_label", "WITH f AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS n FROM events GROUP BY 1) SELECT event_id, n AS event_type FROM events JOIN f USING (event_type)")
def _(spark, sf):
    return mr.encode_categorical(table(spark, sf, "events").select("event_id", "event_type"), "label", order_by="event_id")


@query("encode_target", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type), 6) AS event_type FROM events")
def _(spark, sf):
    return rounded(mr.encode_categorical(table(spark, sf, "events").select("event_id", "event_type", "value"), "target", target="value").select("event_id", "event_type"), ["event_type"])


def _greedy(values: str, threshold: float) -> str:
    """SQL for the greedy rule over ``values`` (``text``, and ``i`` from 1 on): ``nb`` has the earlier texts within the threshold of each, ``kept`` the
    numbers of those that stay. Common subsequences are counted by a bit for each character, so texts have 120 of them at most."""
    return f"""
v AS MATERIALIZED ({values}),
c AS (
    SELECT i, text, length(text) AS n, (1::HUGEINT << length(text)::INT) - 1 AS ones,
        map_from_entries(list_transform(list_distinct(string_split(text, '')), lambda c: {{'k': c, 'v': list_sum(list_transform(range(1, length(text) + 1), lambda j: CASE WHEN text[j] = c THEN 1::HUGEINT << (j - 1)::INT ELSE 0 END))::HUGEINT}})) AS bits
    FROM v),
p AS (
    SELECT b.i, a.i AS j, a.n, b.n AS m,
        list_reduce(list_concat([a.ones], list_transform(string_split(b.text, ''), lambda y: coalesce(a.bits[y], 0)::HUGEINT)), lambda r, h: ((r + (r & h)) | (r - (r & h))) & a.ones) AS rest
    FROM c a JOIN c b ON a.i < b.i AND 200.0 * least(a.n, b.n) >= {threshold} * (a.n + b.n)),
nb AS MATERIALIZED (SELECT i, list(j ORDER BY j) AS js FROM p WHERE 200.0 * (n - bit_count(rest)) >= {threshold} * (n + m) GROUP BY i),
g(i, kept) AS (
    SELECT 0::BIGINT, []::BIGINT[]
    UNION ALL
    SELECT g.i + 1, CASE WHEN len(list_intersect(kept, coalesce(js, []))) > 0 THEN kept ELSE list_append(kept, g.i + 1) END
    FROM g LEFT JOIN nb ON nb.i = g.i + 1 WHERE g.i < (SELECT count(*) FROM v)),
kept AS MATERIALIZED (SELECT kept FROM g ORDER BY i DESC LIMIT 1)"""


_SORTED = "array_to_string(list_sort(list_filter(string_split(lower({0}), ' '), lambda w: w <> '')), ' ')"


@query("fuzzy_cluster")
def _(spark, sf):
    return mr.fuzzy_cluster_categories(table(spark, sf, "part").select("p_partkey", "p_type"), ["p_type"], 95)


@query(
    "fuzzy_cluster_names",
    f"WITH RECURSIVE {_greedy(f"SELECT p_name, {_SORTED.format('p_name')} AS text, row_number() OVER (ORDER BY count(*) DESC, p_name) AS i FROM part GROUP BY p_name", 75)}, "
    "head AS (SELECT v.i, v.p_name, coalesce(list_min(list_intersect(js, kept)), v.i) AS h FROM v CROSS JOIN kept LEFT JOIN nb ON nb.i = v.i) "
    "SELECT p_partkey, w.p_name FROM part JOIN head USING (p_name) JOIN v w ON w.i = CASE WHEN list_contains((SELECT kept FROM kept), head.i) THEN head.i ELSE h END",
)
def _(spark, sf):
    return mr.fuzzy_cluster_categories(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name"], 75)


# duplicates ---------------------------------------------------------------------------------------------------------


@query("dedup_rows", "SELECT DISTINCT text, lang FROM documents")
def _(spark, sf):
    return mr.handle_duplicates(table(spark, sf, "documents").select("text", "lang"))


for _keep, _order in (("first", "ASC"), ("last", "DESC")):

    @query(f"dedup_subset_{_keep}", f"SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {_order}) AS n FROM events) WHERE n = 1")
    def _(spark, sf, keep=_keep):
        return mr.drop_duplicates_subset(table(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], keep, "event_id")


@query("dedup_subset_none", "SELECT event_id, user_id, event_type, day FROM (SELECT *, CAST(ts AS DATE) AS day, count(*) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS n FROM events) WHERE n = 1")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return mr.drop_duplicates_subset(df, ["user_id", "event_type", "day"], "none")


@query(
    "fuzzy_dedup",
    f"WITH RECURSIVE {_greedy(f"SELECT {_SORTED.format('p_name')} AS text, min(p_partkey) AS first, row_number() OVER (ORDER BY min(p_partkey)) AS i FROM part GROUP BY 1", 75)} "
    "SELECT p_partkey, p_name FROM part JOIN v ON first = p_partkey WHERE list_contains((SELECT kept FROM kept), i)",
)
def _(spark, sf):
    return mr.fuzzy_deduplicate(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name"], 75, order_by="p_partkey")


@query(
    "near_dup_urls",
    f"WITH RECURSIVE u AS (SELECT page_id, {_SORTED.format('trim(url)')} AS text FROM pages), {_greedy("SELECT text, min(page_id) AS first, row_number() OVER (ORDER BY min(page_id)) AS i FROM u WHERE text <> '' GROUP BY 1", 90)} "
    "SELECT page_id, v.i IS NOT NULL AND (page_id <> first OR NOT list_contains((SELECT kept FROM kept), v.i)) AS url_near_dup FROM u LEFT JOIN v USING (text)",
)
def _(spark, sf):
    return mr.near_duplicate_text(table(spark, sf, "pages").select("page_id", "url"), "url", 90, order_by="page_id").select("page_id", "url_near_dup")


@query("near_dup_text")
def _(spark, sf):
    return mr.near_duplicate_text(table(spark, sf, "benchmark"), "text", 90, order_by="item_id").select("item_id", "text_near_dup")


# scaling, binning ---------------------------------------------------------------------------------------------------


@query("scale_minmax", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part")
def _(spark, sf):
    return rounded(mr.scale_numeric(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "minmax", ["p_retailprice"]), ["p_retailprice"])


@query("scale_standard", f"SELECT {LINE}, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 6) AS l_extendedprice FROM lineitem")
def _(spark, sf):
    return rounded(mr.scale_numeric(table(spark, sf, "lineitem"), "standard", ["l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"])


@query("scale_robust", f"WITH q AS (SELECT median(l_quantity) AS m, {rank('l_quantity', '0.25')} AS q1, {rank('l_quantity', '0.75')} AS q3 FROM lineitem) SELECT {LINE}, round((l_quantity - m) / (q3 - q1), 6) AS l_quantity FROM lineitem, q")
def _(spark, sf):
    return rounded(mr.scale_numeric(table(spark, sf, "lineitem"), "robust", ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])


_BIN = "CASE WHEN l_quantity <= {a} THEN '(-inf, ' || {ta} || ']' WHEN l_quantity <= {b} THEN '(' || {ta} || ', ' || {tb} || ']' WHEN l_quantity <= {c} THEN '(' || {tb} || ', ' || {tc} || ']' ELSE '(' || {tc} || ', inf]' END"
_INT = {f"t{k}": f"CAST(CAST(b{i} AS BIGINT) AS VARCHAR)" for i, k in ((1, "a"), (2, "b"), (3, "c"))} | {"a": "b1", "b": "b2", "c": "b3"}


@query("bin_quantile", f"WITH q AS (SELECT {rank('l_quantity', '0.25')} AS b1, {rank('l_quantity', '0.5')} AS b2, {rank('l_quantity', '0.75')} AS b3 FROM lineitem) SELECT {LINE}, {_BIN.format(**_INT)} AS l_quantity_bin FROM lineitem, q")
def _(spark, sf):
    return mr.bin_numeric(table(spark, sf, "lineitem"), ["l_quantity"], 4).select("l_orderkey", "l_linenumber", "l_quantity_bin")


@query("bin_uniform", f"WITH m AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 4 AS s FROM lineitem), q AS (SELECT lo + s AS b1, lo + 2 * s AS b2, lo + 3 * s AS b3 FROM m) SELECT {LINE}, CAST(CASE WHEN l_quantity <= b1 THEN 1 WHEN l_quantity <= b2 THEN 2 WHEN l_quantity <= b3 THEN 3 ELSE 4 END AS INT) AS l_quantity_bin FROM lineitem, q")
def _(spark, sf):
    df = mr.bin_numeric(table(spark, sf, "lineitem"), ["l_quantity"], 4, "uniform")
    labels = [r[0] for r in df.groupBy("l_quantity_bin").agg(F.min("l_quantity").alias("m")).orderBy("m").collect()]
    return df.select("l_orderkey", "l_linenumber", F.array_position(F.array(*map(F.lit, labels)), F.col("l_quantity_bin")).cast("int").alias("l_quantity_bin"))


# validation ---------------------------------------------------------------------------------------------------------


@query("range_null", f"SELECT {LINE}, CASE WHEN l_quantity BETWEEN 5 AND 40 THEN l_quantity END AS l_quantity FROM lineitem")
def _(spark, sf):
    return mr.apply_range_rules(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), {"l_quantity": (5.0, 40.0)})


@query("range_clip", f"SELECT {LINE}, least(greatest(l_quantity, 5), 40) AS l_quantity FROM lineitem")
def _(spark, sf):
    return mr.apply_range_rules(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), {"l_quantity": (5.0, 40.0)}, "clip")


@query("range_drop", f"SELECT {LINE}, l_quantity FROM lineitem WHERE l_quantity BETWEEN 5 AND 40")
def _(spark, sf):
    return mr.apply_range_rules(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), {"l_quantity": (5.0, 40.0)}, "drop")


@query("cross_field", "SELECT 'shipped_after_order' AS name, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS violations FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT 'small_tax', count(*) FILTER (WHERE l_tax > 0.05) FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(spark, sf):
    df = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    _, report = mr.check_cross_field(df, {"shipped_after_order": F.col("l_shipdate") >= F.col("o_orderdate"), "small_tax": "l_tax <= 0.05D"})
    return spark.createDataFrame(list(report.items()), "name string, violations long")


@query("validate_formats", "SELECT page_id, url, regexp_matches(url, '^https?://[^\\s]+$') AS url_valid FROM pages")
def _(spark, sf):
    return mr.validate_formats(table(spark, sf, "pages").select("page_id", "url"), {"url": "url"})


#: Well-formed and broken values of every kind, made of columns.
_FORMS = {
    "email": "CASE WHEN c_custkey % 3 = 0 THEN concat(c_mktsegment, '.at.', c_name) WHEN c_custkey % 7 > 0 THEN concat('c', c_custkey, '@example.org') END",
    "ip": "concat('10.', c_nationkey, '.', c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '.7' END)",
    "phone": "concat(CASE WHEN c_custkey % 5 = 0 THEN 'ext ' ELSE '+49 ' END, c_nationkey, '-', c_custkey)",
    "postal": "concat(c_nationkey, CASE WHEN c_custkey % 6 = 0 THEN '/' ELSE ' ' END, c_custkey)",
}


@query("validate_formats_customer", "SELECT c_custkey, " + ", ".join(f"{e} AS {k}, regexp_matches({e}, '{FORMATS[k]}') AS {k}_valid" for k, e in _FORMS.items()) + " FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", *[F.expr(e).alias(k) for k, e in _FORMS.items()])
    return mr.validate_formats(df, {k: k for k in _FORMS})


@query("referential_integrity", "SELECT count(*) AS bad FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def _(spark, sf):
    _, bad = mr.check_referential_integrity(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").where("c_nationkey < 20").select("c_custkey"))
    return spark.createDataFrame([(bad,)], "bad long")


# domains ------------------------------------------------------------------------------------------------------------


@query(
    "canonical_urls",
    "WITH p AS (SELECT page_id, regexp_extract(url, '^([^:/?#]+)://([^/?#]*)([^?#]*)([?][^#]*)?', ['s', 'h', 'p', 'q']) AS u FROM pages) SELECT page_id, lower(u.s) || '://' || lower(u.h) || rtrim(u.p, '/') || CASE WHEN u.q = '?' THEN '' ELSE u.q END AS url FROM p",
)
def _(spark, sf):
    return mr.canonicalize_urls(table(spark, sf, "pages").select("page_id", "url"), ["url"])


@query("country_map", "SELECT n_nationkey, CASE lower(n_name) WHEN 'united states' THEN 'USA!' WHEN 'india' THEN 'India' ELSE lower(n_name) END AS n_name FROM nation")
def _(spark, sf):
    return mr.standardize_country_region(table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_name"], {"United States": "USA!"})


@query("currency", "SELECT o_orderkey, round(o_totalprice * CAST(0.92 AS DOUBLE), 6) AS o_totalprice FROM orders")
def _(spark, sf):
    return rounded(mr.convert_currency(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], {"o_totalprice": 0.92}), ["o_totalprice"])


_CODES = sorted(numbering.codes().items())
#: Numbers of all calling codes, right and wrong in length, as they are written in Germany: abroad with + or 00, at home with or without 0.
_PHONES = (
    f"n AS (SELECT c_custkey, c_custkey % 4 AS kind, '2' || lpad(CAST(c_custkey AS VARCHAR), CAST(3 + c_custkey % 10 AS INT), '3') AS national, 1 + c_custkey % {len(_CODES)} AS i FROM customer)"
)


@query(
    "phones",
    f"WITH c(i, code, lengths, pattern) AS (VALUES {', '.join(f"({i}, '{c}', {list(n)}, '{numbering.PATTERNS.get(c, '.*')}')" for i, (c, n) in enumerate(_CODES, 1))}), {_PHONES}, "
    "w AS (SELECT c_custkey, kind, national, CASE WHEN kind < 2 THEN i ELSE (SELECT i FROM c WHERE code = '49') END AS i FROM n) "
    "SELECT c_custkey, CASE WHEN list_contains(lengths, length(national)) AND regexp_full_match(national, pattern) THEN '+' || code || national END AS phone FROM w JOIN c USING (i)",
)
def _(spark, sf):
    code = F.element_at(F.array(*[F.lit(c) for c, _ in _CODES]), (F.col("c_custkey") % len(_CODES)).cast("int") + 1)
    national = F.concat(F.lit("2"), F.lpad(F.col("c_custkey").cast("string"), (F.col("c_custkey") % 10).cast("int") + 3, "3"))
    kind = F.col("c_custkey") % 4
    raw = F.when(kind == 0, F.concat(F.lit("+"), code, F.lit(" ("), national, F.lit(")"))).when(kind == 1, F.concat(F.lit("00 "), code, F.lit("-"), national)).when(kind == 2, F.concat(F.lit("0"), national, F.lit(" ext. 12"))).otherwise(national)
    return mr.normalize_phone_numbers(table(spark, sf, "customer").select("c_custkey", raw.alias("phone")), ["phone"], "DE")


@query("emails", "SELECT c_custkey, lower(c_name) || '@example.com' AS mail, NOT contains(c_name, ' ') AS mail_valid FROM customer")
def _(spark, sf):
    return mr.normalize_emails(table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" "), "c_name", F.lit("@Example.com ")).alias("mail")), ["mail"])


# balance ------------------------------------------------------------------------------------------------------------


@query("problem_type", "SELECT CASE WHEN count(DISTINCT quality) > 10 THEN 'regression' ELSE 'classification' END AS quality, 'regression' AS n_chars FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    df = labelled(spark, sf)
    return spark.createDataFrame([(mr.check_problem_type(df, "quality"), mr.check_problem_type(df, "n_chars"))], "quality string, n_chars string")


@query("undersample_counts", "WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT quality, min(n) OVER () AS n FROM c")
def _(spark, sf):
    return mr.check_and_handle_imbalance(table(spark, sf, "labels"), "quality", "under").groupBy("quality").agg(F.count("*").alias("n"))


@query("oversample_counts", "WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT quality, max(n) OVER () AS n FROM c")
def _(spark, sf):
    return mr.check_and_handle_imbalance(table(spark, sf, "labels"), "quality", "over").groupBy("quality").agg(F.count("*").alias("n"))


@query("isolation_forest")
def _(spark, sf):
    return mr.remove_outliers_isolation_forest(table(spark, sf, "part"), columns=["p_size", "p_retailprice"]).select("p_partkey", "p_size", "p_retailprice")


# languages, PII, profile --------------------------------------------------------------------------------------------


_NEAREST = r"""
WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS word FROM documents),
m AS (SELECT DISTINCT word, '_' || word || '_' AS m FROM w),
g AS (SELECT word, substr(m, i, n) AS gram FROM (SELECT word, m, n, unnest(range(1, length(m) - n + 2)) AS i FROM m, range(1, 6) t(n))),
p AS (
    SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS r
    FROM (SELECT lang, gram, sum(n) AS n FROM (SELECT lang, word, count(*) AS n FROM w WHERE lang IS NOT NULL GROUP BY 1, 2) JOIN g USING (word) GROUP BY 1, 2)
    QUALIFY r < 300),
d AS (
    SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) - 1 AS r
    FROM (SELECT doc_id, gram, sum(n) AS n FROM (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2) JOIN g USING (word) GROUP BY 1, 2)
    QUALIFY r < 300),
far AS (
    SELECT doc_id, lang, sum(coalesce(abs(d.r - p.r), 300))::BIGINT AS distance
    FROM d CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p USING (lang, gram) GROUP BY 1, 2),
best AS (SELECT doc_id, min(distance) AS distance, min_by(lang, (distance, lang)) AS guess FROM far GROUP BY 1)
"""


@query("detect_language", f"{_NEAREST} SELECT doc_id, guess, distance FROM documents LEFT JOIN best USING (doc_id)")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    found = mr.detect_language(docs, "text", "guess", mr.learn_profiles(docs, "text", "lang"), "distance")
    return found.select("doc_id", "guess", "distance")


@query("filter_by_language", f"{_NEAREST} SELECT doc_id, text FROM best JOIN documents USING (doc_id) WHERE guess = 'de'")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return mr.filter_by_language(docs.select("doc_id", "text"), "text", "de", mr.learn_profiles(docs, "text", "lang"))


@query("redact_profanity", r"SELECT page_id, regexp_replace(html, '(?i)\b(?:article|div|data)\b', '####', 'g') AS html FROM pages")
def _(spark, sf):
    return mr.redact_profanity(table(spark, sf, "pages").select("page_id", "html"), ["html"], ["data", "div", "article"], "#")


#: Words that look like listed ones, and listed ones.
_HIDDEN = "CASE page_id % 6 WHEN 0 THEN 'd4rn ' WHEN 1 THEN 'a D.a.r.n! ' WHEN 2 THEN 'd a r n ' WHEN 3 THEN 'darned ' WHEN 4 THEN 'daaarn, ' ELSE 'Darn it ' END"


@query(
    "redact_disguised",
    "SELECT page_id, CASE page_id % 6 WHEN 0 THEN '**** ' WHEN 1 THEN 'a ****! ' WHEN 2 THEN '**** ' WHEN 3 THEN 'darned ' WHEN 4 THEN '****, ' ELSE '**** it ' END || url AS said FROM pages",
)
def _(spark, sf):
    return mr.redact_profanity(table(spark, sf, "pages").select("page_id", F.concat(F.expr(_HIDDEN), "url").alias("said")), ["said"], ["darn", "blast it"])


_SPELLINGS = {"smalls": 4, "smell": 9, "rings": 3, "ring": 1, "widgets": 2, "rde": 5}


@query(
    "correct_spelling",
    f"WITH v AS (SELECT * FROM (VALUES {', '.join(f"('{w}', {n})" for w, n in _SPELLINGS.items())}) AS v(known, n)), "
    "w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), "
    "c AS (SELECT word, CASE WHEN lower(word) IN (SELECT known FROM v) THEN word ELSE coalesce((SELECT known FROM v WHERE damerau_levenshtein(lower(word), known) <= 2 ORDER BY damerau_levenshtein(lower(word), known), n DESC, known DESC LIMIT 1), word) END AS fixed FROM w), "
    "p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) "
    "SELECT p_partkey, string_agg(fixed, ' ' ORDER BY i) AS p_name FROM p JOIN c USING (word) GROUP BY 1",
)
def _(spark, sf):
    return mr.correct_spelling_text(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name"], _SPELLINGS)


@query("manual_correction", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, sf):
    fixes = {"F": "finished", "O": "open"}
    return mr.fix_spelling_errors_in_categorical(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), corrector=lambda name, values: mr.manual_correction(values, fixes))


@query("correct_categories", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'first' ELSE lower(o_orderpriority) END AS o_orderpriority FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return mr.fix_spelling_errors_in_categorical(df, {"o_orderpriority": {"1-URGENT": "first"}}, lambda name, values: "\n".join(f"- {v.lower()}" for v in values))


@query("pii_mask", f"SELECT doc_id, regexp_replace(regexp_replace(text, '{pii.KINDS['EMAIL_ADDRESS']}', '<EMAIL_ADDRESS>', 'g'), '{pii.KINDS['IP_ADDRESS']}', '<IP_ADDRESS>', 'g') AS text_masked FROM documents")
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    return mr.detect_and_mask_pii(df, columns=["text"], masker=lambda x: pii.mask_text(x, ("EMAIL_ADDRESS", "IP_ADDRESS"))).drop("text")


_DIGITS = "list_transform(string_split(regexp_replace(m, '[^0-9]', '', 'g'), ''), lambda c: TRY_CAST(c AS INT))"
#: The checks of the kinds that have one, on a match ``m``.
_CHECKS = {
    "CREDIT_CARD": f"list_sum(list_transform(list_reverse({_DIGITS}), lambda d, i: CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END)) % 10 = 0",
    "IBAN_CODE": "list_reduce(list_concat([0], list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), "
    "lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1",
    "US_SSN": "substr(m, 1, 3) NOT IN ('000', '666') AND m[1] <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8) <> '0000'",
    "UK_NHS": f"(11 - list_sum(list_transform({_DIGITS}[:9], lambda d, i: d * (11 - i))) % 11) % 11 = {_DIGITS}[10]",
    "PHONE_NUMBER": "NOT regexp_matches(substr(text, s, 1), '[A-Za-z0-9_.]') OR s = 0",
}


def _found(kind: str) -> str:
    """SQL for the spans of a kind in ``documents``: matches are marked, and their places follow from the lengths between the marks."""
    r = pii.RECOGNISERS[kind]
    ahead = f"regexp_matches(lower(substr(text, greatest(s - {pii.BEFORE}, 0) + 1, least(s, {pii.BEFORE}))), '{'|'.join(r.context)}')"
    return (
        f"(SELECT doc_id, s, s + length(m) AS e, '{kind}' AS k, least(1.0, {r.score} + CASE WHEN {ahead} THEN {pii.RAISE} ELSE 0 END)::DOUBLE AS score FROM ("
        f"SELECT doc_id, text, split_part(p[i], chr(2), 1) AS m, CAST(list_sum(list_transform(p[:i - 1], lambda x: length(x))) - (i - 2) AS BIGINT) AS s FROM ("
        f"SELECT doc_id, text, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT doc_id, text, string_split(regexp_replace(text, '({r.pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM documents))) "
        f"WHERE {_CHECKS.get(kind, 'true')})"
    )


@query(
    "pii_mask_all",
    f"WITH f AS ({' UNION ALL '.join(map(_found, pii.KINDS))}), "
    "r AS (SELECT doc_id, list([{'s': s, 'e': e, 'k': k}] ORDER BY score DESC, e - s DESC, s, k) AS spans FROM f GROUP BY doc_id), "
    "kept AS (SELECT doc_id, list_reduce(spans, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN a ELSE list_concat(a, x) END) AS spans FROM r), "
    "cut AS (SELECT doc_id, list_reduce(list_concat([{'s': 0::BIGINT, 'e': 0::BIGINT, 'k': text}], list_reverse_sort(list_transform(spans, lambda x: {'s': x.s::BIGINT, 'e': x.e::BIGINT, 'k': x.k}))), "
    "lambda t, x: {'s': 0::BIGINT, 'e': 0::BIGINT, 'k': substr(t.k, 1, x.s) || '<' || x.k || '>' || substr(t.k, x.e + 1)}).k AS masked FROM kept JOIN documents USING (doc_id)) "
    "SELECT doc_id, coalesce(masked, text, '') AS text_masked FROM documents LEFT JOIN cut USING (doc_id)",
)
def _(spark, sf):
    return mr.detect_and_mask_pii(table(spark, sf, "documents").select("doc_id", "text"), columns=["text"]).drop("text")


@query("value_counts_top20", "SELECT p_type AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 20")
def _(spark, sf):
    return eda.value_counts(table(spark, sf, "part"), "p_type")


_TOP = "(SELECT {c} FROM {t} GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT {n})"


@query("crosstab", f"SELECT p_brand AS a, p_name AS b, count(*) AS count FROM part WHERE p_brand IN {_TOP.format(c='p_brand', t='part', n=eda.BOX_GROUPS)} AND p_name IN {_TOP.format(c='p_name', t='part', n=eda.CROSS_GROUPS)} GROUP BY 1, 2")
def _(spark, sf):
    return eda.crosstab(table(spark, sf, "part"), "p_brand", "p_name")


@query("box_by_category", f"SELECT p_brand AS category, count(*) AS n, round(avg(p_retailprice), 6) AS mean, min(p_retailprice) AS min, max(p_retailprice) AS max FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT {eda.BOX_GROUPS}")
def _(spark, sf):
    return rounded(eda.box_by_category(table(spark, sf, "part"), "p_retailprice", "p_brand"), ["mean"])


@query("five_numbers", " UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS least, {rank(c, '0.25')} AS q1, median({c}) AS median, {rank(c, '0.75')} AS q3, max({c}) AS greatest FROM lineitem" for c in _NUMBERS))
def _(spark, sf):
    got = eda.five_numbers(table(spark, sf, "lineitem"), _NUMBERS)
    rows = [(c, *map(float, v.values())) for c, v in got.items()]
    return spark.createDataFrame(rows, "name string, least double, q1 double, median double, q3 double, greatest double")


@query("preview", f"SELECT * FROM orders ORDER BY o_orderkey LIMIT {eda.PREVIEW}")
def _(spark, sf):
    return eda.preview(table(spark, sf, "orders"), order_by="o_orderkey")


@query("histogram", "WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)) + 1, 20) AS INT) AS bin FROM lineitem, m) SELECT bin, count(*) AS count FROM b GROUP BY 1")
def _(spark, sf):
    return eda.histogram(table(spark, sf, "lineitem"), "l_extendedprice").select("bin", "count")


@query(
    "kpis",
    "SELECT count(*) AS rows, CAST(4 AS BIGINT) AS columns, CAST(1 AS BIGINT) AS numeric, CAST(1 AS BIGINT) AS categorical, round((2 * count(*) - count(quality) - count(toxic)) / (4 * count(*)), 6) AS missing, CAST(0 AS BIGINT) AS duplicates FROM documents LEFT JOIN labels USING (doc_id)",
)
def _(spark, sf):
    got = eda.kpis(labelled(spark, sf).select("doc_id", "lang", "quality", "toxic"))
    return rounded(spark.createDataFrame([tuple(got.values())], "rows long, columns long, numeric long, categorical long, missing double, duplicates long"), ["missing"])


def _issues() -> str:
    """SQL for the rules of ``quality_issues`` over ``customer``."""
    columns, numbers, texts = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), ("c_custkey", "c_acctbal"), ("c_name", "c_mktsegment")
    level = lambda x, high, medium: f"CASE WHEN {x} > {high} THEN 'high' WHEN {x} > {medium} THEN 'medium' ELSE 'low' END"
    found = []
    for c in columns:
        share, different = f"((count(*) - count({c})) / count(*))", f"(count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INT))"
        found.append(f"SELECT {level(share, '0.3', '0.05')} AS severity, 'missing' AS rule, '{c}' AS \"column\", {share} AS value FROM customer HAVING count(*) > count({c})")
        found.append(f"SELECT 'medium', 'constant', '{c}', {different} FROM customer HAVING {different} <= 1")
        found.append(f"SELECT 'low', 'identifier', '{c}', {different} / count(*) FROM customer HAVING {different} / count(*) > 0.95 AND count(*) > 10")
    same = f"(SELECT count(*) AS n FROM customer GROUP BY {', '.join(columns)})"
    found.append(f"SELECT CASE WHEN sum(n) FILTER (n > 1) / sum(n) > 0.05 THEN 'high' ELSE 'medium' END, 'duplicate_rows', NULL, sum(n) FILTER (n > 1) FROM {same} HAVING max(n) > 1")
    for c in numbers:
        out = f"count(*) FILTER ({c} < lo OR {c} > hi)"
        found.append(f"SELECT {level(f'{out} / count({c})', '0.1', '0.02')}, 'outliers', '{c}', {out} FROM customer, (WITH {fences(c, 'customer', 'f')} SELECT * FROM f) HAVING count({c}) >= 8 AND {out} > 0")
        found.append(f"SELECT 'low', 'negative', '{c}', count(*) FROM customer WHERE {c} < 0 HAVING count(*) > 0")
        found.append(f"SELECT 'low', 'skewed', '{c}', {_SKEW.format(x=c)} FROM customer, (SELECT avg({c}) AS m FROM customer) HAVING abs({_SKEW.format(x=c)}) > 1")
    for c in texts:
        found.append(f"SELECT 'low', 'whitespace', '{c}', count(*) FROM customer WHERE {c} <> trim(regexp_replace({c}, '\\s+', ' ', 'g')) HAVING count(*) > 0")
        found.append(f"SELECT 'medium', 'casing', '{c}', count(DISTINCT {c}) - count(DISTINCT lower({c})) FROM customer HAVING count(DISTINCT {c}) > count(DISTINCT lower({c}))")
    return "SELECT severity, rule, \"column\", CAST(value AS DOUBLE) AS value FROM (" + " UNION ALL ".join(found) + ")"


@query("quality_issues", _issues())
def _(spark, sf):
    return eda.quality_issue_table(table(spark, sf, "customer"))


@query("pipeline_customer")
def _(spark, sf):
    return mr.clean_data(table(spark, sf, "customer"))
