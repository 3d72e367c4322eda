"""The pipeline against its stages' rules, and on odd tables."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, langid, pu_quality, spaced_seeds

DATA = "/root/testdata/sf0.01"


def five_words(text):
    """The five-word shingles of a text, by the words of op9."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def similar(x, y):
    if min(len(x), len(y)) < 0.8 * max(len(x), len(y)):
        return False
    common = len(x & y)
    return common >= 0.8 * (len(x) + len(y) - common)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")


def test_run_is_the_stages_one_after_another(spark, tables):
    docs, labels, benchmark = tables
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fit(langid.training_rows(docs))
    language = {r.doc_id: r.p for r in docs.select("doc_id", langid.predict(docs, model).alias("p")).collect()}
    left = {i for i in rows if language[i].lang != "und" and language[i].score >= 0.5}
    kept = docs.where(docs.doc_id.isin(*left))
    described = pu_quality.describe(kept)
    quality = pu_quality.fit(described, pu_quality.trusted(labels))
    left = {r.doc_id for r in kept.select("doc_id", pu_quality.score(kept, quality).alias("s")).collect() if r.s >= 0.3}
    shingles = {i: five_words(rows[i]) for i in left}
    first = {}
    for i in sorted(left):  # components by search
        if i not in first:
            first[i], queue = i, [i]
            while queue:
                a = queue.pop()
                for b in left:
                    if b not in first and similar(shingles[a], shingles[b]):
                        first[b] = i
                        queue.append(b)
    assert any(first[i] != i and rows[i] != rows[first[i]] for i in left)
    left = {i for i in left if first[i] == i}
    items = {r.item_id: spaced_seeds._TOKENS.findall(r.text.lower()) for r in benchmark.collect()}
    plain = {i: " " + " ".join(spaced_seeds._TOKENS.findall(rows[i].lower())) + " " for i in left}
    leaks = {i for i in left if any(" " + " ".join(t) + " " in plain[i] for t in items.values())}
    assert leaks
    assert set(got) == left - leaks
    codec = bpe.codec(bpe.default_path())
    for i, r in got.items():
        ids, _ = codec.encode(rows[i])
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(rows[i].encode()).hexdigest())


def test_stages_keep_columns_and_odd_rows(spark, tables):
    docs, _, _ = tables
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", "s", 0), (0, "repeated id", "en", "s", 11), (0, "repeated id", "en", "s", 11)], docs.schema)
    mixed = docs.union(odd)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, mixed, DATA)
        assert out.columns == docs.columns and 0 < out.count() <= mixed.count(), name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    coded = corpus_pipeline.encode(spark, mixed, DATA)
    assert coded.count() == mixed.count() and coded.where("doc_id IS NULL").first().n_tokens == 0
    assert corpus_pipeline.encode(spark, docs.limit(0), DATA).count() == 0
    once = corpus_pipeline.drop_near_duplicates(spark, mixed, DATA)
    assert once.where("text = 'repeated id'").count() == 1  # equal rows are near-duplicates, another text under their id is not
    assert once.where("doc_id = 0").count() == 2 and once.where("doc_id IS NULL OR doc_id = 900001").count() == 1


def test_rows_without_an_id_are_judged_one_by_one(spark, tables):
    docs, _, benchmark = tables
    item = benchmark.first().text
    clean = "a quiet harbour where boats wait for the morning tide and nobody counts the hours until the lamps go out again"
    odd = spark.createDataFrame([(None, item, "en", "s", 0), (None, clean, "en", "s", 0), (None, clean + " today", "en", "s", 0)], docs.schema)
    assert {r.text for r in corpus_pipeline.decontaminate(spark, odd, DATA).collect()} == {clean, clean + " today"}
    kept = {r.text for r in corpus_pipeline.drop_near_duplicates(spark, odd, DATA).collect()}
    assert len(kept) == 2 and item in kept


def test_extra_columns_of_any_name(spark, tables):
    docs, _, _ = tables
    names = ["figures", "language", "row_number", "_row_number", "row", "node", "key", "component", "first", "words"]
    wide = docs.limit(60)
    for k, n in enumerate(names):
        wide = wide.withColumn(n, F.lit(k))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, wide, DATA)
        assert out.columns == wide.columns and out.count() > 0, name
    assert corpus_pipeline.encode(spark, wide, DATA).count() == 60
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "decontamination", "bpe"]
