"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run in full into a sink that discards rows. ``preprocess_50k`` is the text preprocessing of 50,000 documents
(the table repeated); its rows per second are printed beside the total, and so is how many times as fast it is as the same steps in a
plain Python loop over the rows (timed on one core over the documents once).
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import millrace as mr
from millrace.functions.text import TEXT_STEPS
from millrace.functions.words import CONTRACTIONS, STOPWORDS
from millrace.plans import catalogue

HEADLINE = [
    "remove_outliers_sequential", "outliers_by_group", "mad_filter", "winsorize_price", "corr_pairs", "collinear_drop", "scale_standard",
    "scale_robust", "bin_quantile", "normalize_whitespace_documents", "preprocess_text", "canonical_urls", "impute_median", "impute_interpolate",
    "encode_onehot", "encode_target", "rare_categories", "dedup_rows", "dedup_subset_first", "parse_dates", "expand_json", "range_clip", "pii_mask",
    "quality_issues", "pipeline_customer",
]


def timed(f) -> float:
    start = time.perf_counter()
    f().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def plain_seconds(texts: list[str | None]) -> float:
    """The steps of ``preprocess_text`` row by row in Python."""
    steps = [(re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern)), new) for pattern, new in TEXT_STEPS]
    dropped = set(STOPWORDS)
    start = time.perf_counter()
    for text in texts:
        out = " ".join(CONTRACTIONS.get(w, w) for w in (text or "").lower().split())
        for pattern, new in steps:
            out = pattern.sub(new, out)
        " ".join(w for w in out.split() if w not in dropped)
    return time.perf_counter() - start


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timed(lambda: spark.read.parquet(f"{sf_dir}/lineitem.parquet"))  # the session is up before the clock runs
    seconds = {name: timed(lambda name=name: catalogue.QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5)))).repartition(4 * int(cpus))
    seconds["preprocess_50k"] = timed(lambda: docs.select(mr.preprocess_text(F.col("text")).alias("text")))
    rows = docs.count()
    plain = 5 * plain_seconds([r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()])
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "preprocess_rows_per_second": round(rows / seconds["preprocess_50k"]), "plain_python_seconds": round(plain, 3), "times_plain_python": round(plain / seconds["preprocess_50k"], 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
