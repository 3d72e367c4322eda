"""The corpus pipeline: documents through language ID, quality, near-duplicates, decontamination and BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes each stage's result
as Parquet to the shared folder and reads it back for the next. Language ID learns from the whole ``documents`` table by the
split rule of its query; the quality classifier learns from the documents it is given and the whole ``labels`` table.

Defined cases, of every stage: null and empty texts, repeated rows, rows that share an id or have none, very long texts and extra
columns of any name are allowed, and rows are judged one by one, never through their ids; an empty table gives an empty table.
Null and empty texts have no language and go with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, langid, pu_quality, simhash, spaced_seeds
from millrace.llm.common import fresh_name, materialise, numbered, small_side

#: A document whose best language has a lower posterior than this is rejected, as is one without letters.
LANGUAGE_SCORE = 0.5
#: Near-duplicates: words of a shingle, and the similarity of the shingle sets.
SHINGLE, SIMILARITY = 5, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told: one with letters, and a posterior of ``LANGUAGE_SCORE`` or more."""
    model = langid.fit(langid.training_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    name = fresh_name(docs, "language")
    found = docs.withColumn(name, langid.predict(docs, model))
    return found.where((F.col(f"{name}.lang") != langid.UNDETERMINED) & (F.col(f"{name}.score") >= LANGUAGE_SCORE)).select(docs.columns)


def without(rows: DataFrame, gone: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` but those whose key is in ``gone``, without the key. Texts are not shuffled unless very many rows go."""
    return rows.join(small_side(materialise(gone.select(key), name)), key, "left_anti").drop(key)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier predicts good. Texts are described once: what is learnt from is scored."""
    rows, key = numbered(docs, "pipeline-rows")
    described = pu_quality.describe(rows, key)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = materialise(pu_quality.trusted(labels).distinct(), "pipeline-trusted")
    good = rows.select(key, "doc_id").join(ids, "doc_id").select(key)
    model = pu_quality.fit(described, good, key)
    return without(rows, described.where(pu_quality.score_figures(described, model) < pu_quality.THRESHOLD), key, "pipeline-rejected")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near-duplicates: the one with the least id (null ids last), then the first of its rows."""
    rows, key = numbered(docs, "pipeline-rows")
    groups = simhash.similar_groups(rows, key, shingle=SHINGLE, similarity=SIMILARITY)
    named = groups.join(rows.select(key, "doc_id"), key).select("component", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", key).alias("member"))
    named = materialise(named, "pipeline-groups")
    first = named.groupBy("component").agg(F.min("member").alias("first"), F.count("*").alias("members")).where("members > 1")
    gone = named.join(first, "component").where("member <> first").select(F.col(f"member.{key}").alias(key))
    return without(rows, gone, key, "pipeline-duplicates")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    rows, key = numbered(docs, "pipeline-rows")
    leaks = spaced_seeds.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return without(rows, leaks.select(key).distinct(), key, "pipeline-leaks")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every kept document, with the digests of a round trip."""
    coded = bpe.encode(docs, decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]
#: Learnt models and segmentation are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
