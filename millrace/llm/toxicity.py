"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, their stems (leading bytes, so that forms of one word share a coordinate), word
pairs, and pairs that skip one or two words, hashed to ``BITS`` bits. The learner is FTRL-proximal: every coordinate has its own rate, and the L1 term keeps most weights at exactly zero, so the
weights that are broadcast are few.

Fitting takes at most about ``LABEL_BOUND`` labelled rows (a documented bound for the classifier, drawn by id and then by row),
dealt by row to shards of ``SHARD_ROWS`` rows; every shard runs its own learner over its rows in a task, and the weights are averaged in
Spark. Scoring reads every whole text: weights are looked up first, and only features with a weight are counted.

Defined cases: null and empty texts have no features and get the score of the bias; without any labelled row, or with one
class only, the bias is what the labels' share gives (0.5 without rows); null labels are not learnt; repeated labels of one
document count as rows of their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import crc_mod, materialise, row_share, small_batches

BITS = 20
LABEL_BOUND = 24_000
SHARD_ROWS = 8_000
EPOCHS = 12
#: Weight of a toxic row's gradient: toxic rows are the rare ones.
POSITIVE_WEIGHT = 4.0
THRESHOLD = 0.7
#: The learner's probability at which a text's score is ``THRESHOLD``: L1 shrinks weights, so the learner is too reserved.
#: Chosen by three-fold cross-validation on training rows (best F1); held-out rows have no part in it.
LEVEL = 0.4
#: Stems are the first so many bytes of longer words.
STEMS = (5, 6, 7)
_WORDS = re.compile(r"\w+")
_ODD = (np.random.default_rng(5).integers(1, 2**62, 7, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def features(text: str | None) -> np.ndarray:
    """Hashed words, stems, pairs and skip-pairs of a text, repeats included."""
    words = " ".join(_WORDS.findall((text or "").lower())).encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    if not len(h):
        return np.zeros(0, np.int64)
    shift = np.uint64(64 - BITS)
    grams = [(h + np.uint64(1)) * _ODD[0] >> shift]
    for k in STEMS:
        stems = [w[:k] for w in words if len(w) > k]
        grams.append((np.fromiter(map(zlib.crc32, stems), np.uint64, len(stems)) + np.uint64(1 + k)) * _ODD[0] >> shift)
    for gap in (1, 2, 3):  # neighbours, then pairs that skip one or two words
        grams.append((h[:-gap] * _ODD[2 * gap - 1] + h[gap:] * _ODD[2 * gap]) >> shift)
    return np.concatenate(grams).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; weights are made from the sums as they are needed."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 24.0, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * (POSITIVE_WEIGHT if label else 1.0)
        before = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - before) / self.alpha * w


@dataclass
class Model:
    """Coordinates with a weight, ascending, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = LABEL_BOUND, epochs: int = EPOCHS) -> Model:
    """Learns from the rows of ``labels`` (already the training part) joined to their texts."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    rows = known.count()
    if not rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    parts = 1_000_000_000
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(parts)) < (parts if rows <= bound else int(parts * bound / rows)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(known), "id")  # about ``bound`` ids of one label or two

    @F.pandas_udf("array<int>")
    def distinct(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([np.unique(features(x if isinstance(x, str) else None)).astype(np.int32) for x in part])

    described = materialise(joined.select("label", F.xxhash64("id").alias("order"), distinct("text").alias("at")), "toxicity-labelled")
    held = described.count()  # an id may be on many rows
    drawn = described.where(row_share(held, bound))
    shards = max(1, round(min(held, bound) / SHARD_ROWS))
    drawn = drawn.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "order", F.monotonically_increasing_id()), F.lit(shards)))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        own = Ftrl(1 << BITS)
        pdf = pdf.sort_values("order", kind="stable")
        rows = [(np.append(np.asarray(at, np.int64), 1 << BITS), label) for at, label in zip(pdf["at"], pdf["label"])]
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                own.update(*rows[k])
        w = own.weights()
        at = np.flatnonzero(w)
        at = at if len(at) and at[-1] == 1 << BITS else np.append(at, 1 << BITS)  # the bias is always sent
        return pd.DataFrame({"at": at, "w": w[at] * len(rows), "rows": len(rows)})

    learnt = drawn.groupBy("shard").applyInPandas(learn, "at long, w double, rows long").groupBy("at").agg(F.sum("w").alias("w"), F.sum("rows").alias("rows"))
    sums = learnt.toPandas().sort_values("at")  # at most 2**BITS + 1 rows, few of them because of L1
    if not len(sums):
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    total = sums["rows"].max()
    at, w = sums["at"].to_numpy(np.int64), sums["w"].to_numpy() / total
    return Model(at[:-1], w[:-1], float(w[-1]))


def score(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """How likely a text of ``df`` is toxic (double): the learner's log odds, moved so that ``LEVEL`` becomes ``THRESHOLD``."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    moved = np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(LEVEL / (1 - LEVEL)) if len(model.index) else 0.0

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[model.index] = model.weight
        for part in parts:
            out = np.full(len(part), model.bias + moved)
            for k, text in enumerate(part):
                at = features(text if isinstance(text, str) else None)
                at = np.unique(at[weights[at] != 0])
                out[k] += weights[at].sum(dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return run(F.col(text_col).cast("string"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(crc_mod("doc_id", 3) != 1))
    found = docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), score(docs, model).alias("score"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
