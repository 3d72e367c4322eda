"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Words are lower-cased runs of word characters, and every word of the corpus has its own probability (counts over all
documents). The network's classes hold the ``WORDS`` most frequent; every other word falls into one of ``BUCKETS`` hash
buckets, and its probability is that of the bucket times its share of the bucket's tokens in the corpus. The words are counted
in parts of a dictionary, so their number may grow with the corpus while the network that tasks hold stays as it is. The network reads the ``REACH`` tokens on either
side, each place with its own embedding weights, through one tanh layer, and gives the token's probability as that of its
class times that within the class (both softmax), so that probabilities sum to one at a fraction of a full softmax's cost.

Training is data parallel: each task takes Adagrad steps over the positions of its own documents, starting from the same
weights; the weights are averaged, weighted by positions, in rounds of bounded groups, and the next pass starts from the
average. Texts are split once, to chunks that all passes and the scoring read: the chunk's distinct words, and its documents with
their words as numbers among those. A word crosses the network once a chunk, however often it occurs there: lists of words go to
the parts of the dictionary, which answer with the counts of the whole corpus. A pass takes every ``STRIDE``-th position of every document, each pass others, and there are as many passes as that:
every position of the corpus is learnt from once. Scoring sums the log probabilities of all positions of a whole text.

Defined cases: null and empty texts have no tokens, a score of 0 and no mean; a corpus without words leaves the network as
initialised; ties in the vocabulary go by the word; very long texts are read whole; repeated rows are learnt from and scored each;
an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, small_batches
from millrace.llm.importance import _numbers, _packed, _planes, _unpacked

CLASSES, PER_CLASS = 32, 32
BUCKETS = 64
VOCABULARY = CLASSES * PER_CLASS
WORDS = VOCABULARY - BUCKETS
PAD = VOCABULARY
REACH, EMBEDDING, HIDDEN = 2, 16, 32
STRIDE, PASSES, BATCH, RATE = 2, 2, 2048, 0.08
#: Positions that the network scores at once.
SCORED = 1 << 12
#: Weight vectors averaged in one group, and at most so many come to the driver.
FAN_IN = 32
#: Tokens of a chunk (a longer text is one by itself), tokens for each part of the dictionary, and tokens that are learnt from or scored together.
CHUNK_TOKENS, PART_TOKENS, TOGETHER = 1 << 21, 1 << 22, 1 << 18
#: Words a task counts before it passes its counts on.
COUNTED = 500_000
_TOKENS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _TOKENS.findall(text.lower()) if text else []


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: how often each word occurs in all texts."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
            if len(counts) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counted = df.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int = WORDS) -> list[str]:
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def vocabulary(df: DataFrame, text_col: str = "text", size: int = WORDS) -> list[str]:
    """The ``size`` most frequent words of all texts, most frequent first."""
    return most_frequent(word_counts(df, text_col), size)


def token_ids(text: str | None, index: dict[str, int]) -> np.ndarray:
    words = words_of(text)
    known = map(index.get, words)
    return np.array([k if k is not None else WORDS + zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for k, w in zip(known, words)], np.int32)


def chunked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each chunk of documents: ``chunk`` (a number), ``ids``, ``lengths`` in tokens, ``tokens`` (numbers of the chunk's words, all
    documents end to end), ``words`` and ``times`` (how often each occurs in the chunk). Written out: texts are split here and nowhere else."""
    small_batches(df.sparkSession)
    names = ["chunk", "ids", "n_tokens", "lengths", "tokens", "words", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        ids: list[pa.Array] = []
        lengths: list[int] = []
        tokens: list[np.ndarray] = []
        words: defaultdict[str, int] = defaultdict()
        words.default_factory = words.__len__

        def row() -> pa.RecordBatch:
            flat = np.concatenate(tokens)
            each = pa.concat_arrays(ids)
            blobs = [_planes(np.array(lengths)), _planes(flat), _packed("\n".join(words).encode()), _planes(np.bincount(flat, minlength=len(words)))]
            columns = [pa.array([chunk]), pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), each), pa.array([len(flat)])]
            return pa.RecordBatch.from_arrays(columns + [pa.array([b], pa.binary()) for b in blobs], names=names)

        held = 0
        for batch in batches:
            done = 0
            for k, text in enumerate(batch.column(1)):
                found = words_of(text.as_py())
                tokens.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                lengths.append(len(found))
                held += len(found)
                if held >= CHUNK_TOKENS:
                    ids.append(batch.column(0).slice(done, k + 1 - done))
                    yield row()
                    chunk, done, held = chunk + 1, k + 1, 0
                    for x in (ids, lengths, tokens, words):
                        x.clear()
            if done < batch.num_rows:
                ids.append(batch.column(0).slice(done))
        if lengths:
            yield row()

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema[0].dataType.simpleString()
    return materialise(src.mapInArrow(run, f"chunk long, ids array<{kind}>, n_tokens long, lengths binary, tokens binary, words binary, times binary"), "lm-chunks")


def _strings(blob: bytes) -> list[str]:
    raw = _unpacked(blob)
    return raw.decode().split("\n") if raw else []


def _crcs(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))


def _by_part(crcs: np.ndarray, parts: int) -> list[np.ndarray]:
    """The places of the words of each part of the dictionary."""
    part = crcs // BUCKETS % parts
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, parts)))


LISTS = "part int, chunk long, words binary, times binary"


def _lists(chunk: int | None, words: list[str], times: np.ndarray, parts: int) -> pa.RecordBatch:
    dealt = [(k, at) for k, at in enumerate(_by_part(_crcs(words), parts)) if len(at)]
    columns = [pa.array([k for k, _ in dealt], pa.int32()), pa.array([chunk] * len(dealt), pa.int64())]
    columns += [pa.array([_packed("\n".join([words[i] for i in at.tolist()]).encode()) for _, at in dealt], pa.binary())]
    columns += [pa.array([_packed(times[at].astype("<i8").tobytes()) for _, at in dealt], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "words", "times"])


def _chunk_lists(chunks: DataFrame, parts: int) -> DataFrame:
    """For every chunk and part of the dictionary the chunk's words there, and how often each occurs in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, times in zip(*batch.columns):
                yield _lists(chunk.as_py(), _strings(words.as_py()), _numbers(times.as_py()), parts)

    return chunks.select("chunk", "words", "times").mapInArrow(run, LISTS)


def _corpus_lists(counts: DataFrame, parts: int) -> DataFrame:
    """The same of a table of ``word`` and ``n``, without a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _lists(None, batch.column(0).to_pylist(), np.asarray(batch.column(1), np.int64), parts)

    return counts.select("word", F.col("n").cast("long")).mapInArrow(run, LISTS)


def dictionary(chunks: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Counts of the corpus (``counts``, else the chunks themselves) for the words of every chunk, written out.

    Each part merges its lists of words. It gives a row for every chunk with the counts of the words of its list (``n``), and one row with
    its ``WORDS`` most frequent words, their counts (``word``, ``times``) and the tokens of each bucket (``totals``).
    """
    parts = 1 + (chunks.agg(F.sum("n_tokens")).first()[0] or 0) // PART_TOKENS
    lists = _chunk_lists(chunks, parts)
    given = counts is not None
    if given:
        lists = lists.unionAll(_corpus_lists(counts, parts))

    def run(table: pa.Table) -> pa.Table:
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__
        read = []
        for chunk, words, times in zip(*(table.column(c) for c in ("chunk", "words", "times"))):
            own = _strings(words.as_py())
            at = np.fromiter(map(index.__getitem__, own), np.int32, len(own))
            read.append((chunk.as_py(), at, np.frombuffer(_unpacked(times.as_py()), "<i8")))
        n = np.zeros(len(index), np.int64)
        for chunk, at, times in read:  # a word is once in a list
            if (chunk is None) == given:
                n[at] += times
        words = list(index)
        totals = np.zeros(BUCKETS, np.int64)
        np.add.at(totals, _crcs(words) % BUCKETS, n)
        least = np.partition(n, -WORDS)[-WORDS] if len(n) > WORDS else 1
        top = np.flatnonzero(n >= max(least, 1)).tolist()
        top = sorted(top, key=lambda i: (-n[i], words[i]))[:WORDS]
        part = table.column("part")[0].as_py()
        out = [(part, chunk, _packed(n[at].tobytes()), None, None, None) for chunk, at, _ in read if chunk is not None]
        out.append((part, None, None, [words[i] for i in top], n[top].tolist(), totals.tolist()))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["part", "chunk", "n", "word", "times", "totals"])

    merged = lists.groupBy("part").applyInArrow(run, "part int, chunk long, n binary, word array<string>, times array<long>, totals array<long>")
    return materialise(merged, "lm-dictionary")


def frequent(answers: DataFrame) -> DataFrame:
    """``word`` and ``n`` of each part's most frequent words, the ``WORDS`` most frequent of all among them."""
    return answers.where("chunk is null").select(F.explode(F.arrays_zip("word", "times")).alias("e")).select(F.col("e.word").alias("word"), F.col("e.times").alias("n"))


SHAPES = {
    "embedding": (VOCABULARY + 1, EMBEDDING),
    "inner": (2 * REACH * EMBEDDING, HIDDEN),
    "inner_bias": (HIDDEN,),
    "classes": (HIDDEN, CLASSES),
    "classes_bias": (CLASSES,),
    "words": (CLASSES, HIDDEN, PER_CLASS),
    "words_bias": (CLASSES, PER_CLASS),
}


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial(seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = [np.zeros(shape) if name.endswith("bias") else rng.normal(0, 0.1 if name == "embedding" else shape[-2] ** -0.5 / 2, shape) for name, shape in SHAPES.items()]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


#: Logits of a softmax within these bounds are used as they are: sums of their exponentials neither overflow nor vanish.
SAFE = 60.0


def _safe(net: dict[str, np.ndarray]) -> bool:
    """Whether no hidden layer (from -1 to 1) can give logits beyond ``SAFE``, so that no row's greatest need be taken off."""
    most = max(np.abs(net["classes"]).sum(axis=0).max(), np.abs(net["words"]).sum(axis=1).max())
    return most + max(np.abs(net["classes_bias"]).max(), np.abs(net["words_bias"]).max()) < SAFE


def _exponentials(x: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """``x`` (used up) to exponentials of each row, and their sums."""
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _slopes(x: np.ndarray, at: np.ndarray, n: int, safe: bool) -> np.ndarray:
    """Slopes of the negative log softmax of each row at one place, over ``n``; ``x`` is used up."""
    x, total = _exponentials(x, safe)
    total *= n
    x /= total[:, None]
    x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at] -= x.dtype.type(1 / n)
    return x


def _hidden(net: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = net["embedding"].take(context.ravel(), axis=0).reshape(len(context), -1)
    h = x @ net["inner"]
    h += net["inner_bias"]
    h *= 2  # tanh(z) = 1 - 2 / (exp(2 z) + 1)
    np.clip(h, -SAFE, SAFE, out=h)
    np.exp(h, out=h)
    h += 1
    np.divide(-2, h, out=h)
    h += 1
    return x, h


def _picked(x: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
    """Log softmax of each row at one place; ``x`` is used up."""
    own = x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at]
    if not safe:
        own -= x.max(axis=1)
    return own - np.log(_exponentials(x, safe)[1])


def log_probabilities(net: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target | context) of every row; rows are sorted by class, so that a class is a slice."""
    order = np.argsort((target // PER_CLASS).astype(np.int8), kind="stable")
    kind, place = np.divmod(target[order], PER_CLASS)
    safe = _safe(net)
    _, h = _hidden(net, context.take(order, axis=0))
    found = _picked(h @ net["classes"] + net["classes_bias"], kind, safe)
    cuts = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
    x = net["words_bias"].take(kind, axis=0)
    for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            x[a:b] += h[a:b] @ net["words"][c]
    found += _picked(x, place, safe)
    out = np.empty_like(found)
    out[order] = found
    return out


def gradient(net: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gradient (flat) of the mean negative log probability."""
    n = len(target)
    order = np.argsort((target // PER_CLASS).astype(np.int8), kind="stable")  # a class is a slice
    context, (kind, place) = context.take(order, axis=0), np.divmod(target[order], PER_CLASS)
    safe = _safe(net)
    x, h = _hidden(net, context)
    flat = np.zeros(sum(int(np.prod(s)) for s in SHAPES.values()), np.float32)
    g = unpack(flat)
    ones = np.ones(n, h.dtype)
    d = h @ net["classes"]
    d += net["classes_bias"]
    d = _slopes(d, kind, n, safe)
    g["classes"][:] = h.T @ d
    g["classes_bias"][:] = ones @ d
    back = d @ net["classes"].T
    cuts = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
    held = [(c, a, b) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    words, slopes = net["words"], g["words"]
    d = net["words_bias"].take(kind, axis=0)
    for c, a, b in held:
        d[a:b] += h[a:b] @ words[c]
    d = _slopes(d, place, n, safe)
    g["words_bias"][[c for c, _, _ in held]] = np.add.reduceat(d, [a for _, a, _ in held], axis=0)
    for c, a, b in held:
        own = d[a:b]
        slopes[c] = h[a:b].T @ own
        back[a:b] += own @ words[c].T
    h *= h
    np.subtract(1, h, out=h)
    back *= h
    g["inner"][:] = x.T @ back
    g["inner_bias"][:] = ones @ back
    by_token = (back @ net["inner"].T).reshape(-1, EMBEDDING)
    at = context.ravel().astype(np.int16)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    g["embedding"][at[first]] = np.add.reduceat(by_token.take(order, axis=0), first, axis=0)
    return flat


def windows(ids: np.ndarray, sizes: np.ndarray, first: int = 0, stride: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, targets and the number of the text for every token of texts of these ``sizes`` that lie end to end in ``ids``, or for
    every ``stride``-th of each text from its ``first`` on; PAD stands beyond the ends."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids))
    at = place + REACH * (owner + 1)
    line = np.full(len(ids) + REACH * (len(sizes) + 1), PAD, np.int32)
    line[at] = ids
    if stride > 1:
        take = np.flatnonzero((place - np.repeat(np.cumsum(sizes) - sizes, sizes)) % stride == first)
        at, owner = at[take], owner[take]
    offsets = [k for k in range(-REACH, REACH + 1) if k]
    return np.stack([line[at + k] for k in offsets], axis=1), line[at], owner


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[slice, slice]]:
    """Runs of texts of about ``most`` tokens: their places among the texts, and their tokens'."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        before = int(ends[a] - sizes[a])
        b = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(a, b), slice(before, int(ends[b - 1]))
        a = b


def _network_ids(words: list[str], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The network's number of each word, and its bucket (-1 for words that the network tells apart)."""
    known = np.array([index.get(w, -1) for w in words], np.int32)
    bucket = np.where(known < 0, _crcs(words) % BUCKETS, -1)
    return np.where(known < 0, WORDS + bucket, known).astype(np.int32), bucket


@dataclass
class Model:
    words: list[str]
    flat: np.ndarray

    def index(self) -> dict[str, int]:
        return {w: k for k, w in enumerate(self.words)}


def _trained(chunks: DataFrame, words: list[str], start: np.ndarray, turn: int, stride: int, passes: int = PASSES) -> DataFrame:
    """``shard``, ``n`` and ``w`` (32-bit floats): the weights each task reaches from ``start`` over its documents."""
    shared = chunks.sparkSession.sparkContext.broadcast((start, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, index = shared.value[0], {w: k for k, w in enumerate(shared.value[1])}
        flat, seen, squares = start.copy(), 0, np.full(len(start), 1e-6, np.float32)
        net = unpack(flat)
        left: list[tuple[np.ndarray, np.ndarray]] = []

        def steps(context: np.ndarray, target: np.ndarray) -> None:
            for a in range(0, len(target), BATCH):
                g = gradient(net, context[a : a + BATCH], target[a : a + BATCH])
                np.add(squares, g * g, out=squares)
                g *= RATE
                g /= np.sqrt(squares)
                np.subtract(flat, g, out=flat)

        def documents() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for lengths, tokens, own in zip(*batch.columns):
                    sizes = _numbers(lengths.as_py()).astype(np.int64)
                    ids = _network_ids(_strings(own.as_py()), index)[0][_numbers(tokens.as_py())]
                    for texts, at in _groups(sizes, TOGETHER):
                        yield ids[at], sizes[texts]

        for ids, sizes in documents():
            context, target, _ = windows(ids, sizes, (turn * stride) // passes % stride, stride)
            seen += len(target)
            left.append((context, target))
            if sum(len(t) for _, t in left) >= BATCH:
                context, target = (np.concatenate(x) for x in zip(*left))
                mixed = np.random.default_rng(seen).permutation(len(target))
                context, target = context[mixed], target[mixed]
                whole = len(target) // BATCH * BATCH
                steps(context[:whole], target[:whole])
                left = [(context[whole:], target[whole:])]
        if left:
            context, target = (np.concatenate(x) for x in zip(*left))
            if len(target):
                steps(context, target)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["shard", "n", "w"])

    return chunks.select("lengths", "tokens", "words").mapInArrow(run, "shard long, n long, w binary")


def _averaged(pdf: pd.DataFrame) -> tuple[int, np.ndarray]:
    total = int(pdf["n"].sum())
    w = sum(n * np.frombuffer(x, np.float32).astype(np.float64) for n, x in zip(pdf["n"], pdf["w"]))
    return total, (w / total).astype(np.float32) if total else np.frombuffer(pdf["w"].iloc[0], np.float32)


def average(shards: DataFrame) -> np.ndarray | None:
    """The mean of all weight vectors, weighted by ``n``: groups of ``FAN_IN`` by ``FAN_IN``, the last group on the driver."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total, w = _averaged(pdf.sort_values("shard"))
        return pd.DataFrame({"shard": [int(pdf["shard"].min()) // FAN_IN], "n": [total], "w": [w.tobytes()]})

    shards = materialise(shards, "lm-weights")
    while shards.count() > FAN_IN:
        shards = materialise(shards.withColumn("group", F.floor(F.col("shard") / FAN_IN)).groupBy("group").applyInPandas(merge, "shard long, n long, w binary"), "lm-weights")
    rows = shards.toPandas().sort_values("shard")
    return _averaged(rows)[1] if len(rows) else None


def fit(df: DataFrame, text_col: str = "text", stride: int = STRIDE, passes: int = PASSES, words: list[str] | None = None, chunks: DataFrame | None = None) -> Model:
    """``words``: the most frequent of ``df``, if they are known; ``chunks``: ``df`` as ``chunked`` gives it."""
    small_batches(df.sparkSession)
    words, flat = vocabulary(df, text_col) if words is None else words, initial()
    chunks = chunked(df.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col)), "doc_id", text_col) if chunks is None else chunks
    for turn in range(passes):
        reached = average(_trained(chunks, words, flat, turn, stride, passes))
        flat = flat if reached is None else reached
    return Model(words, flat)


def pseudo_log_likelihoods(net: dict[str, np.ndarray], index: dict[str, int], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens, and summed conditional log probabilities, of each text."""
    ids = [token_ids(t, index) for t in texts]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return sizes, _summed(net, np.concatenate([np.zeros(0, np.int32), *ids]), sizes)


def _summed(net: dict[str, np.ndarray], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Summed log probabilities of texts of these ``sizes`` that lie end to end in ``ids``."""
    sums = np.zeros(len(sizes))
    for texts, at in _groups(sizes, TOGETHER):
        context, target, owner = windows(ids[at], sizes[texts])
        for a in range(0, len(target), SCORED):
            part = slice(a, a + SCORED)
            sums[texts] += np.bincount(owner[part], weights=log_probabilities(net, context[part], target[part]), minlength=len(sums[texts]))
    return sums


def score(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct column: ``n_tokens``, ``pll`` (the summed log probabilities) and ``mean`` (by token; null without tokens).

    By the network alone: a word beyond its classes counts with its bucket's probability. ``log_likelihoods`` has all words' own.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_tokens long, pll double, mean double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net, index = unpack(shared.value.flat), shared.value.index()
        for part in parts:
            n, sums = pseudo_log_likelihoods(net, index, [x if isinstance(x, str) else None for x in part])
            yield pd.DataFrame({"n_tokens": n, "pll": sums, "mean": np.divide(sums, n, out=np.full(len(n), np.nan), where=n > 0)})

    scored = run(F.col(text_col).cast("string"))
    return scored


def word_shares(counts: DataFrame, words: list[str]) -> DataFrame:
    """``word`` and ``log_share`` (of its bucket's tokens) of all counted words that are not among ``words``."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(w,) for w in words], "word string")
    rare = counts.join(F.broadcast(known), "word", "left_anti").withColumn("bucket", F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(BUCKETS)))
    totals = rare.groupBy("bucket").agg(F.sum("n").alias("total"))
    return rare.join(F.broadcast(totals), "bucket").select("word", (F.log("n") - F.log("total")).alias("log_share"))


def log_likelihoods(df: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunks: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """``id_col``, ``n_tokens``, ``pll`` and ``mean`` of every row of ``df``, each word with its own probability.

    ``counts`` are those of the corpus (``word_counts``), ``df`` included. ``chunks``: ``df`` as ``chunked`` gives it; ``answers``: the
    ``dictionary`` of the corpus for these chunks, and then ``counts`` needs the words of the model only.
    """
    small_batches(df.sparkSession)
    chunks = chunked(df, id_col, text_col) if chunks is None else chunks
    answers = dictionary(chunks, counts) if answers is None else answers
    parts = 1 + (chunks.agg(F.sum("n_tokens")).first()[0] or 0) // PART_TOKENS
    totals = np.zeros(BUCKETS)
    for r in answers.select(F.posexplode("totals").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        totals[r.bucket] = r.n
    known = df.sparkSession.createDataFrame([(w,) for w in model.words], "word string")
    for r in counts.join(F.broadcast(known), "word").select("word", "n").collect():  # as many as the model has words
        totals[zlib.crc32(r.word.encode("utf-8", "surrogatepass")) % BUCKETS] -= r.n
    shared = df.sparkSession.sparkContext.broadcast((model.flat, model.words, totals))
    kind = chunks.schema["ids"].dataType.elementType.simpleString()

    def run(chunk: pa.Table, given: pa.Table) -> pa.Table:
        flat, known, totals = shared.value
        lengths, tokens, own = (chunk.column(c)[0].as_py() for c in ("lengths", "tokens", "words"))
        sizes, tokens, own = _numbers(lengths).astype(np.int64), _numbers(tokens), _strings(own)
        numbers, bucket = _network_ids(own, {w: k for k, w in enumerate(known)})
        n = np.zeros(len(own), np.int64)
        answer = dict(zip(given.column("part").to_pylist(), given.column("n").to_pylist()))
        for part, at in enumerate(_by_part(_crcs(own), parts)):
            if len(at):
                n[at] = np.frombuffer(_unpacked(answer[part]), np.int64)
        rare = (bucket >= 0) & (n > 0)
        share = np.zeros(len(own))
        share[rare] = np.log(n[rare]) - np.log(totals[bucket[rare]])
        within = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=share[tokens], minlength=len(sizes))
        pll = _summed(unpack(flat), numbers[tokens], sizes) + within
        mean = pa.array(np.divide(pll, sizes, out=np.zeros(len(sizes)), where=sizes > 0), mask=sizes == 0)
        return pa.Table.from_arrays([chunk.column("ids").combine_chunks().flatten(), pa.array(sizes), pa.array(pll), mean], names=[id_col, "n_tokens", "pll", "mean"])

    lists = answers.where("chunk is not null").select("chunk", "part", "n")
    docs = chunks.select("chunk", "ids", "lengths", "tokens", "words")
    return docs.groupBy("chunk").cogroup(lists.groupBy("chunk")).applyInArrow(run, f"`{id_col}` {kind}, n_tokens long, pll double, mean double")


def op10_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chunks = chunked(docs)
    answers = dictionary(chunks)
    counts = frequent(answers)
    model = fit(docs, words=most_frequent(counts), chunks=chunks)
    found = log_likelihoods(docs, model, counts, chunks=chunks, answers=answers)
    return found.select("doc_id", "n_tokens", "pll", F.col("mean").alias("mean_log_probability"))
