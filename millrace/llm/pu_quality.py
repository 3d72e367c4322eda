"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are rows labelled good; everything else is unlabelled web text, good and bad alike. A small network g is
trained on the risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)):  the bracket estimates the risk on the unseen
negatives and is kept from going below zero, which would be overfitting. The class prior is estimated: with U = prior * P +
(1 - prior) * N, every region A of the score axis has prior <= U(A) / P(A), so the least such ratio over upper regions of a
positive-against-unlabelled score is the estimate.

A text is described by shape figures of the whole text (shares of character kinds, repetition of words and lines,
compressibility, lengths of words and sentences). They are standardised by means and deviations over all documents.

Every document is learnt from as unlabelled text. Documents are dealt to learners of about ``SHARD_ROWS`` by a hash of their ids and
figures, so which of them learn together does not depend on files. In each round every learner takes Adam steps against the trusted
positives, from the same weights, in even passes over all its documents, and the weights are averaged in Spark. The prior's ratios
are counted over all documents too. Only the trusted positives are bounded: about ``BOUND`` labelled rows, drawn by row (a documented
bound). The level of decision is set by two folds of the trusted positives: how far unseen ones fall below those learnt from.

Defined cases: null and empty texts have zero figures and are scored like any text, and so are very long ones, which are read
whole; equal texts have equal scores, to the last bit and wherever they lie; an empty table gives no rows; without positives
every score is 0.5; null ids are nobody's label; null labels are no labels; a document that carries several labels is positive
if one is; rows equal in id and text share a learner, which takes them in blocks of bounded size; ties of outputs at a cut count as
above it; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import crc_mod, materialise, row_share, small_batches
from millrace.llm.pseudo_likelihood import average

#: Trusted positives that learning takes, about.
BOUND = 20_000
#: Documents of one learner, about, and of one block at least where more come together; documents of one step, about, and the steps a
#: learner makes at least (in whole passes over its documents).
SHARD_ROWS, BLOCK_ROWS, BATCH, STEPS = 50_000, 100_000, 256, 500
#: Rounds of learning and averaging on the risk.
ROUNDS = 3
HIDDEN = 32
THRESHOLD = 0.3
#: The level of decision: this quantile of the trusted positives, lowered by shares of its distance to their median: the share by which
#: unseen positives fall below it in the folds, and ``MARGIN``.
LOW_SHARE, MARGIN = 0.001, 0.25
#: Bytes whose shares are figures of their own: ASCII punctuation, and kinds of bytes.
_PUNCTUATION = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)


def _kinds() -> np.ndarray:
    kind = np.full(256, 6)
    kind[65:91], kind[97:123], kind[48:58] = 0, 1, 2
    kind[[9, 11, 12, 13, 32]], kind[10] = 3, 4
    kind[128:] = 5
    return kind


_KIND = _kinds()
_NAMES = 12 + 7 + len(_PUNCTUATION)


def figures(text: str | None) -> np.ndarray:
    """The shape figures of a text; zeros for an empty one."""
    out = np.zeros(_NAMES, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    counts = np.zeros(256, np.int64)
    for k in range(0, len(raw), 1 << 20):
        counts += np.bincount(np.frombuffer(raw[k : k + (1 << 20)], np.uint8), minlength=256)
    n = len(raw)
    words = raw.split()
    m = max(1, len(words))
    different = len(set(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    tails = sum(1 for w in words if not (w[-1] > 127 or w[-1:].isalnum() or w[-1:] in b".,;:!?"))
    out[:12] = [
        np.log1p(n),
        np.log1p(m),
        sum(map(len, words)) / m,
        different / m,
        np.log(different + 1) / np.log(m + 1),
        sum(a == b for a, b in zip(words, words[1:])) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(m / max(1, len(lines))),
        len(zlib.compress(raw, 1)) / (n + 20),
        sum(map(bytes.isupper, words)) / m,
        tails / m,
        np.log1p(m / (1 + counts[46] + counts[33] + counts[63])),
    ]
    out[12:19] = np.bincount(_KIND, weights=counts, minlength=7) / n
    out[19:] = np.log1p(100 * counts[_PUNCTUATION] / n)
    return out


@dataclass
class Model:
    """Standardisation, the network (one hidden layer of rectified units), the estimated class prior, and the output
    below which hardly any trusted positive lies: there the score is ``THRESHOLD``."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float
    level: float = 0.0

    def output(self, x: np.ndarray) -> np.ndarray:
        """The network's output of every row. Sums run over features and units in a fixed order, so that a row's output does not
        depend on the rows beside it."""
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        inner, bias, outer, last = self.layers
        hidden = np.zeros((len(x), len(bias))) + bias
        for k in range(len(inner)):
            hidden += x[:, k, None] * inner[k]
        hidden = np.maximum(hidden, 0)
        out = np.zeros(len(x)) + last[0]
        for k in range(len(outer)):
            out += hidden[:, k] * outer[k]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), 0.5)
        return np.round(_sigmoid(self.output(x) - self.level + np.log(THRESHOLD / (1 - THRESHOLD))), 12)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ layers[0] + layers[1], 0)
    return hidden, hidden @ layers[2] + layers[3][0]


def _gradient(layers: list[np.ndarray], x: np.ndarray, by_output) -> list[np.ndarray]:
    hidden, out = _forward(layers, x)
    d = by_output(out)
    back = d[:, None] * layers[2] * (hidden > 0)
    return [x.T @ back, back.sum(axis=0), hidden.T @ d, np.array([d.sum()])]


class Learner:
    """Adam on the non-negative risk with logistic loss; with ``prior`` None on plain positive-against-unlabelled loss."""

    def __init__(self, layers: list[np.ndarray], p: np.ndarray, prior: float | None, seed: int, rate: float = 0.005, decay: float = 1e-5) -> None:
        self.layers, self.p, self.prior, self.rate, self.decay = layers, p, prior, rate, decay
        self.rng = np.random.default_rng(seed)
        self.first, self.second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
        self.steps = 0

    def step(self, xu: np.ndarray) -> None:
        """One step on the unlabelled rows ``xu`` and as many positives, drawn again each time."""
        layers, prior = self.layers, self.prior
        xp = self.p[self.rng.integers(0, len(self.p), len(xu))]
        gp, gu = _forward(layers, xp)[1], _forward(layers, xu)[1]
        positive = lambda g: (_sigmoid(g) - 1) / len(xu)  # noqa: E731  of loss(g, +1)
        negative = lambda g: _sigmoid(g) / len(xu)  # noqa: E731  of loss(g, -1)
        if prior is None:
            parts = [(xp, positive), (xu, negative)]
        else:
            rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            if rest >= 0:
                parts = [(xp, lambda g: prior * (positive(g) - negative(g))), (xu, negative)]
            else:  # the estimated negative risk fell below zero: step back up
                parts = [(xp, lambda g: prior * negative(g)), (xu, lambda g: -negative(g))]
        self.steps += 1
        for k, g in enumerate(sum(g) for g in zip(*[_gradient(layers, x, f) for x, f in parts])):
            g = g + self.decay * layers[k]
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            self.layers[k] = layers[k] - self.rate * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)


def _initial(seed: int = 0) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, _NAMES**-0.5, (_NAMES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]


def _flat(layers: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in layers]).astype(np.float32)


def _layers(flat: np.ndarray) -> list[np.ndarray]:
    cuts = np.cumsum([_NAMES * HIDDEN, HIDDEN, HIDDEN])
    inner, bias, outer, last = np.split(flat.astype(float), cuts)
    return [inner.reshape(_NAMES, HIDDEN), bias, outer, last]


def learners(own: DataFrame, rows: int) -> DataFrame:
    """``shard``, ``n`` and ``x``: the figures of all rows of ``own`` (``id``, ``figures``), one row a learner, written out.

    A learner's documents lie in the order of their hashes, so equal tables give equal learners, however their files are cut.
    """
    shards = 1 + rows // SHARD_ROWS
    key = F.xxhash64("id", "figures", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    keyed = own.select(key.alias("key"), "figures").withColumn("shard", F.pmod("key", F.lit(shards)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, block, shard = [], [], 0, 0

        def packed(n: int | None = None) -> pa.RecordBatch:
            k, x = np.concatenate(keys), np.concatenate(values)
            keys[:], values[:] = ([], []) if n is None else ([k[n:]], [x[n:]])
            k, x = k[:n], x[:n]
            x = x[np.lexsort((*x.T[:1], k))].astype("<f4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([shard + shards * block]), pa.array([len(k)], pa.int64()), pa.array([x], pa.binary())], names=["shard", "n", "x"])

        for batch in batches:
            shard = batch.column("shard")[0].as_py() if len(batch) else shard
            keys.append(batch.column("key").to_numpy(zero_copy_only=False))
            values.append(batch.column("figures").flatten().to_numpy(zero_copy_only=False).reshape(-1, _NAMES))
            if sum(map(len, keys)) >= 2 * BLOCK_ROWS:
                yield packed(BLOCK_ROWS)
                block += 1
        if sum(map(len, keys)):
            yield packed()

    return materialise(keyed.groupBy("shard").applyInArrow(pack, "shard long, n long, x binary"), "quality-learners")


def passes(rows: int, steps: int) -> tuple[int, int]:
    """Even passes over ``rows`` documents, and the steps of a pass, so that they are ``steps`` at least."""
    each = max(1, round(rows / BATCH))
    return -(-steps // each), each


def learnt(learner: Learner, x: np.ndarray, steps: int) -> None:
    """Takes every row of ``x`` equally often, each pass in an order of its own."""
    turns, each = passes(len(x), steps)
    for _ in range(turns):
        for rows in np.array_split(learner.rng.permutation(len(x)), each):
            learner.step(x[rows])


def _learnt(own: DataFrame, p: np.ndarray, mean: np.ndarray, scale: np.ndarray, layers: list[np.ndarray], prior: float | None, turn: int, steps: int) -> DataFrame:
    """``shard``, ``n`` and ``w``: the weights every row of ``own`` (``learners``) reaches."""
    shared = own.sparkSession.sparkContext.broadcast((p, mean, scale, layers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, mean, scale, layers = shared.value
        for batch in batches:
            for shard, n, x in zip(*batch.columns):
                x = np.frombuffer(x.as_py(), "<f4").reshape(-1, _NAMES)
                learner = Learner([w.copy() for w in layers], p, prior, seed=1000 * shard.as_py() + turn)
                x = x - mean
                x /= scale
                learnt(learner, np.clip(x, -8, 8, out=x), steps)
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()]), pa.array([n.as_py()]), pa.array([_flat(learner.layers).tobytes()], pa.binary())], names=["shard", "n", "w"])

    return own.mapInArrow(run, "shard long, n long, w binary")


def lowest_ratio(p: np.ndarray, above: np.ndarray, cuts: np.ndarray) -> float:
    """The least U(A) / P(A) over the regions above each of ``cuts``; ``above`` has U's shares there, ``p`` the positives' outputs."""
    ratios = [share / (p >= c).mean() for share, c in zip(above, cuts)]
    return float(np.clip(min(ratios), 0.05, 0.97))


def prior_cuts(p: np.ndarray) -> np.ndarray:
    """Cuts above which a tenth of the positives or more lie."""
    return np.quantile(p, np.linspace(0.0, 0.9, 46))


def with_figures(df: DataFrame, text_col: str = "text") -> Column:
    """The figures of every text of ``df`` as an array column."""
    small_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([figures(x if isinstance(x, str) else None) for x in part])

    return run(F.col(text_col).cast("string"))


def fit(described: DataFrame, positives: DataFrame, id_col: str = "doc_id", bound: int = BOUND, steps: int = STEPS, figures_col: str = "figures") -> Model:
    """Learns from ``described`` (``id_col``, ``figures_col``; all documents, written out) and the ids of trusted positives."""
    own = described.select(F.col(id_col).alias("id"), F.col(figures_col).alias("figures"))
    known = positives.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    stats = own.select(*[F.col("figures")[k].alias(f"f{k}") for k in range(_NAMES)])
    row = stats.agg(F.count("*"), *[F.avg(f"f{k}") for k in range(_NAMES)], *[F.stddev_pop(f"f{k}") for k in range(_NAMES)]).first()
    rows, good = row[0], known.count()
    if not rows or not good:
        return Model(np.zeros(_NAMES), np.ones(_NAMES), [], 0.5)
    mean, scale = np.array(row[1 : 1 + _NAMES], float), np.array(row[1 + _NAMES :], float)
    scale = np.where(scale > 1e-6, scale, 1.0)
    parts = 1_000_000_000
    few = known.where(F.pmod(F.xxhash64("id"), F.lit(parts)) < (parts if good <= bound else int(parts * bound / good)))  # distinct ids: about ``bound``
    trusted_rows = own.join(F.broadcast(few), "id").select("figures")
    p = trusted_rows.where(row_share(trusted_rows.count(), bound)).toPandas()  # about ``bound`` rows, though an id may be on many
    if not len(p):
        return Model(mean, scale, [], 0.5)
    p = np.stack(p["figures"]).astype(np.float32)
    p = p[np.lexsort(p.T)]
    fold = np.array([zlib.crc32(x.tobytes()) % 2 == 0 for x in p])  # equal texts lie in one fold
    p = np.clip((p - mean) / scale, -8, 8)
    slim = learners(own, rows)

    def reached(p: np.ndarray, prior: float | None, turns: int) -> Model:
        layers = _initial()
        for turn in range(turns):
            layers = _layers(average(_learnt(slim, p, mean, scale, layers, prior, turn, steps)))
        return Model(mean, scale, layers, prior or 0.5)

    folds = [fold, ~fold] if fold.any() and not fold.all() else []
    learn, read = folds if folds else [fold | True] * 2  # the prior is read off rows the score has not seen
    plain = reached(p[learn], None, 1)
    seen = plain.output(p[read] * scale + mean)
    cuts = prior_cuts(seen)
    outputs = own.select(_outputs(described, plain)(F.col("figures")).alias("g"))
    above = outputs.agg(*[F.avg((F.col("g") >= float(c)).cast("double")) for c in cuts]).first()
    prior = lowest_ratio(seen, np.array(above), cuts)
    model = reached(p, prior, ROUNDS)
    falls = [fall(reached(p[part], prior, ROUNDS), p[part] * scale + mean, p[~part] * scale + mean) for part in folds]
    model.level = level(model.output(p * scale + mean), max([0.0, *falls]) + MARGIN)
    return model


def fall(model: Model, learnt: np.ndarray, unseen: np.ndarray) -> float:
    """How far the low quantile of unseen positives lies below that of learnt ones, in shares of the distance to their median."""
    low, middle = np.quantile(model.output(learnt), [LOW_SHARE, 0.5])
    return float((low - np.quantile(model.output(unseen), LOW_SHARE)) / max(middle - low, 1e-9))


def level(outputs: np.ndarray, slack: float) -> float:
    """The output at which the score is ``THRESHOLD``, from those of the trusted positives; never on a positive itself."""
    low, middle = np.quantile(outputs, [LOW_SHARE, 0.5])
    return float(low - slack * (middle - low) - 1e-3)


def _outputs(df: DataFrame, model: Model):
    """A function from figures to the network's output."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(shared.value.output(np.stack(part.to_list()).astype(float)) if len(part) else [], dtype=float)

    return run


def score_figures(df: DataFrame, model: Model, col: str = "figures") -> Column:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(shared.value.score(np.stack(part.to_list()).astype(float)) if len(part) else [], dtype=float)

    return run(F.col(col))


def score(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score (0 to 1, higher is better) of every text of ``df``."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.array([figures(x if isinstance(x, str) else None) for x in part], float).reshape(len(part), _NAMES)
            yield pd.Series(shared.value.score(x))

    return run(F.col(text_col).cast("string"))


def trusted(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Ids labelled good in the training part."""
    return labels.where((crc_mod(id_col, 5) != 0) & (F.col(label_col) == 1)).select(id_col)


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``figures`` of every row, written out."""
    return materialise(docs.select(F.col(id_col), with_figures(docs, text_col).alias("figures")), "quality-figures")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    described = describe(docs)
    model = fit(described, trusted(labels))
    found = described.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), score_figures(described, model).alias("score"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
