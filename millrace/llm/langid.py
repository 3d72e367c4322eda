"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. The probability of a word is the sum over all its
segmentations into pieces, by the forward algorithm; pieces do not cross words, so a text's probability is the product over
its words, and word scores can be cached. Words are runs of letters, lower-cased, with the vocabulary's word-start mark;
a letter the vocabulary lacks is spelt with its byte pieces.

Fitting counts the pieces of all training texts in Spark (one row per language and piece leaves a task); the model has at
most languages x vocabulary numbers, whatever the input.

Defined cases: a null text or one without letters is ``und`` with score 0; so is everything if no language was learnt; null
languages are never learnt; ties go to the language first in order; very long texts are read whole; repeated rows are counted and
scored each; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import crc_mod, resident, small_batches

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNDETERMINED = "und"
#: Smoothing count of every piece in every language.
SMOOTHING = 0.05
#: Most languages a model can hold: languages x vocabulary numbers come to the driver and go to every task.
MAX_LANGUAGES = 500
#: Words in each of the two generations of a worker's cache.
CACHE_WORDS = 80_000
#: A word of so many letters or more is scored with rescaling, by itself.
LONG_WORD = 40
#: So is any word with a forward sum below this, far above where sums lose digits.
LEAST_SUM = 1e-250
_WORDS = re.compile(r"[^\W\d_]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. Number forms such as fractions, which ``\\w`` takes too, end a word."""
    words = _WORDS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def count_pieces(df: DataFrame, text_col: str = "text", lang_col: str = "lang", path: str | None = None) -> DataFrame:
    """``lang``, ``piece`` (id) and ``n``: how often each piece occurs in the texts of each language."""
    path = path or default_path()
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resident(("pieces", path), lambda: _processor(path))
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0), batch.column(1)):
                by_lang.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            for lang, counts in by_lang.items():
                total = totals.setdefault(lang, np.zeros(own.get_piece_size(), np.int64))
                ids = own.encode(list(counts), num_threads=1)
                sizes = [len(x) for x in ids]
                np.add.at(total, np.fromiter((i for x in ids for i in x), np.int64, sum(sizes)), np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), sizes))
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "piece", "n"])

    src = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    src = src.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return src.mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages in order, log prior shares and piece probabilities (pieces x languages)."""

    langs: list[str]
    prior: np.ndarray
    probs: np.ndarray
    path: str
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", path: str | None = None, smoothing: float = SMOOTHING) -> Model:
    """A model of every language named in ``lang_col``. More than ``MAX_LANGUAGES`` different names raise a ``ValueError``: such a
    column holds something else, and is to be cleaned first."""
    path = path or default_path()
    names = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(lang_col).distinct()
    if (found := names.limit(MAX_LANGUAGES + 1).count()) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has {found} different values or more; a model holds {MAX_LANGUAGES} languages")
    rows = count_pieces(df, text_col, lang_col, path).toPandas()  # languages x vocabulary at most
    langs = sorted(rows["lang"].unique())
    counts = np.full((_processor(path).get_piece_size(), len(langs)), smoothing)
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        counts[own["piece"].to_numpy(), k] += own["n"].to_numpy()
    total = counts.sum(axis=0)
    prior = np.log((total + 1) / (total + 1).sum()) if langs else np.zeros(0)
    return Model(langs, prior, counts / total if langs else counts, path)


class Scorer:
    """Scores words by the forward algorithm, a batch of new words at a time."""

    def __init__(self, model: Model) -> None:
        own = _processor(model.path)
        self.model = model
        self.index: dict[str, int] = {}
        self.bytes = np.zeros((256, len(model.langs)))
        for i in range(own.get_piece_size()):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = model.probs[i]
            elif not (own.is_control(i) or own.is_unknown(i) or own.is_unused(i)):
                self.index[piece] = i
        self.longest = max(map(len, self.index), default=1)
        self.prefixes = {p[:k] for p in self.index for k in range(1, len(p) + 1)}
        self.suffixes = {p[k:] for p in self.index for k in range(len(p))}
        self.rows = model.probs.tolist()
        self.cache: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)))
        self.older: tuple[dict[str, int], np.ndarray] = ({}, self.table)

    def spelt(self, char: str) -> np.ndarray:
        """Probability of a character by its bytes."""
        return np.prod(self.bytes[list(char.encode("utf-8", "surrogatepass"))], axis=0)

    def long_word(self, word: str) -> np.ndarray:
        """Log probabilities of one long word: the forward sums of the last positions only, rescaled as they shrink."""
        s, n = MARK + word, len(word) + 1
        ring = [np.zeros(len(self.model.langs)) for _ in range(self.longest + 1)]
        ring[0] = ring[0] + 1.0
        shift = np.zeros(len(self.model.langs))
        for i in range(n):
            here = ring.pop(0)
            ring.append(np.zeros(len(here)))
            scale = np.where(here > 0, here, 1.0)
            if scale.min() < 1e-100:
                ring = [r / scale for r in ring]
                shift += np.log(scale)
                here = here / scale
            if s[i] not in self.index:
                ring[0] = ring[0] + here * self.spelt(s[i])
            for k in range(1, min(self.longest, n - i) + 1):
                piece = s[i : i + k]
                if piece not in self.prefixes:
                    break
                if piece in self.index:
                    ring[k - 1] = ring[k - 1] + here * self.model.probs[self.index[piece]]
        return np.log(ring[0]) + shift

    def score(self, words: list[str]) -> np.ndarray:
        """Log probabilities, a row for each of ``words`` in sorted order: neighbours share the sums of their common prefix."""
        index, suffixes, longest, probs = self.index, self.suffixes, self.longest, self.rows
        out = np.empty((len(words), len(self.model.langs)))
        forward = [[1.0] * len(self.model.langs)]
        before = ""
        for w, word in enumerate(words):
            s = MARK + word
            n = len(s)
            same = 0
            for x, y in zip(s, before):
                if x != y:
                    break
                same += 1
            del forward[same + 1 :]
            for j in range(same + 1, n + 1):
                total = None
                for i in range(j - 1, max(-1, j - 1 - longest), -1):
                    piece = s[i:j]
                    at = index.get(piece)
                    if at is not None:
                        if total is None:
                            total = [x * y for x, y in zip(forward[i], probs[at])]
                        else:
                            total = [t + x * y for t, x, y in zip(total, forward[i], probs[at])]
                    elif piece not in suffixes:
                        break
                if s[j - 1] not in index:
                    spelt = (self.spelt(s[j - 1]) * forward[j - 1]).tolist()
                    total = spelt if total is None else [t + x for t, x in zip(total, spelt)]
                forward.append(total or [0.0] * len(self.model.langs))
            out[w] = forward[n]
            before = s
        small = np.flatnonzero((out < LEAST_SUM).any(axis=1))
        out[small] = 1.0
        out = np.log(out)
        for w in small:
            out[w] = self.long_word(words[w])
        return out

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Summed word scores of each text (with the prior), and whether it has any letter."""
        split = [words_of(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.older = (self.cache, self.table)
            self.cache, self.table = {}, np.zeros((0, len(self.model.langs)))
        old, old_table = self.older
        new = sorted(set().union(*split) - self.cache.keys())
        known = [w for w in new if w in old]
        fresh = [w for w in new if w not in old]
        short = [w for w in fresh if len(w) < LONG_WORD]
        long = [w for w in fresh if len(w) >= LONG_WORD]
        rows = [old_table[[old[w] for w in known]] if known else self.table[:0], self.score(short)]
        rows += [np.array([self.long_word(w) for w in long])] if long else []
        first = len(self.table)
        self.table = np.concatenate([self.table, *rows])
        self.cache.update(zip([*known, *short, *long], range(first, len(self.table))))
        out = np.zeros((len(texts), len(self.model.langs)))
        for k, words in enumerate(split):
            if words:
                out[k] = self.table[np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))].sum(axis=0)
        for w in long:  # long words are kept for one batch only
            del self.cache[w]
        return out + self.model.prior, np.array([bool(w) for w in split])

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        if not self.model.langs:
            return pd.DataFrame({"lang": [UNDETERMINED] * len(texts), "score": 0.0})
        total, lettered = self.totals(texts)
        total -= total.max(axis=1, keepdims=True)
        share = np.exp(total)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        lang = np.where(lettered, np.array(self.model.langs, object)[best], UNDETERMINED)
        return pd.DataFrame({"lang": lang, "score": np.where(lettered, share[np.arange(len(best)), best], 0.0)})


def scorer(model: Model) -> Scorer:
    """The scorer, with its cache, of this Python worker."""
    return resident(("langid", model.name), lambda: Scorer(model))


def predict(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct column (``lang``, ``score``) for the texts of ``df``; the model is broadcast (bounded by the vocabulary)."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = scorer(shared.value)
        for part in texts:
            yield own.predict([x if isinstance(x, str) else None for x in part])

    return run(F.col(text_col).cast("string"))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(crc_mod(id_col, 3) != 1)


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(training_rows(docs))
    found = docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), predict(docs, model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
