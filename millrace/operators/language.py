"""Languages by rank profiles of character n-grams.

A profile is the ``SIZE`` most frequent n-grams (1 to 5 letters, words marked at both ends) of a language's texts, in order of
frequency. A text has such an order too; its distance to a language is the sum over its n-grams of how far out of place each is,
``SIZE`` for one that the profile lacks. The least distance tells the language.

``learn_profiles`` counts in Spark: tasks count packed n-grams of their texts as arrays, and the counts are added up by language and n-gram,
so no text and no hot word meets in a task. ``detect_language`` takes such a table, or the profiles that come with the library, made by the same rule
from a public declaration and common words of ``len(DECLARATION)`` languages. Profiles are broadcast: at most ``SIZE`` rows a language.

Defined cases: null and blank texts, and texts without letters, have no language; ties of frequency go by the n-gram in code point
order, ties of distance to the language first in order; very long texts are read whole; repeated rows are judged each; an empty
table gives no rows; columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.public_texts import DECLARATION
from millrace.functions.selectors import col
from millrace.functions.storage import fresh_name

SIZE, LONGEST = 300, 5
#: Bits of a character in a packed n-gram, places of texts whose n-grams are counted at once, and counts that a task holds.
BITS, STEP, HELD = 12, 1 << 18, 1 << 20


def words_of(x: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(x.cast("string"), F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def marked_words(x: Column) -> Column:
    """The words one after the other, each marked at both ends."""
    return F.array_join(F.transform(words_of(x), lambda w: F.concat(F.lit("_"), w, F.lit("_"))), "")


def grams(word: str) -> list[str]:
    """All n-grams of a word marked at both ends."""
    marked = f"_{word}_"
    return [marked[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(marked) - n + 1)]


def ranking(words: Counter, size: int = SIZE) -> dict[str, int]:
    """The most frequent n-grams of counted words with their ranks from 0 on."""
    counts: Counter = Counter()
    for word, times in words.items():
        for g in grams(word):
            counts[g] += times
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]
    return {g: r for r, (g, _) in enumerate(top)}


def out_of_place(text: dict[str, int], profile: dict[str, int], size: int = SIZE) -> int:
    """The distance of a text's ranking to a profile."""
    return sum(abs(r - profile[g]) if g in profile else size for g, r in text.items())


def learn_profiles(df: DataFrame, text_col: str, lang_col: str, size: int = SIZE) -> DataFrame:
    """``lang``, ``gram`` and ``rank`` of every language in ``lang_col`` (rows without one are left out)."""
    texts = df.where(col(lang_col).isNotNull()).select(col(lang_col).cast("string").alias("lang"), marked_words(col(text_col)).alias("marked"))
    totals = texts.mapInArrow(_gram_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # ranks of the first ``size`` only: Spark cuts each partition to them before the rows of a language meet
    placed = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    return placed.select("lang", "gram", (F.col("rank") - 1).alias("rank"))


def shipped_profiles(size: int = SIZE) -> dict[str, dict[str, int]]:
    """Profiles of the languages that come with the library."""
    return {lang: ranking(Counter(re.findall(r"[^\W\d_]+", text.lower())), size) for lang, text in DECLARATION.items()}


def packed(gram: str) -> int:
    """An n-gram as a number: ``BITS`` bits a character from the left, so that numbers are in code point order."""
    return sum(ord(c) << BITS * (LONGEST - 1 - i) for i, c in enumerate(gram))


def counted_grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams of words marked at both ends, one after the other, in order, and how often each occurs."""
    ends = np.flatnonzero(codes == ord("_"))[1::2] + 1
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(codes))  # characters of the word from each on
    wide = np.concatenate([codes.astype(np.int64), np.zeros(LONGEST, np.int64)])
    ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(codes), STEP):
        b = min(a + STEP, len(codes))
        key, keys = np.zeros(b - a, np.int64), []
        for n in range(LONGEST):
            key = key | wide[a + n : b + n] << BITS * (LONGEST - 1 - n)
            keys.append(key[left[a:b] > n])
        some, times = np.unique(np.concatenate(keys), return_counts=True)
        if len(ids):
            ids, where = np.unique(np.concatenate([ids, some]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, times])).astype(np.int64)
        else:
            ids, counts = some, times
    return ids, counts


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return ids, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang``, ``gram`` and ``n``: counts of a task, in parts of bounded size."""

    def batch_of(lang: str, found: list[str] | np.ndarray, n: list[int] | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    def unpacked(lang: str, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        codes = np.stack([ids >> BITS * (LONGEST - 1 - i) & (1 << BITS) - 1 for i in range(LONGEST)], axis=1).astype("<u4")
        return batch_of(lang, codes.view(f"<U{LONGEST}").ravel().tolist(), counts)

    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}

    def count(lang: str) -> Iterator[pa.RecordBatch]:
        new = counted_grams(np.concatenate(waiting.pop(lang)))
        held[lang] = _added([held[lang], new]) if lang in held else new
        if sum(len(ids) for ids, _ in held.values()) > HELD:
            yield from (unpacked(k, *held.pop(k)) for k in list(held))

    for batch in batches:
        for lang, marked in zip(batch.column(0), batch.column(1)):
            lang, marked = lang.as_py(), marked.as_py()
            codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
            if len(codes) and codes.max() >= 1 << BITS:  # scripts beyond the first 4,096 characters
                far: Counter = Counter()
                for word, times in Counter(marked[1:-1].split("__")).items():
                    for g in grams(word):
                        far[g] += times
                yield batch_of(lang, list(far), list(far.values()))
            elif len(codes):
                waiting.setdefault(lang, []).append(codes)
                if sum(map(len, waiting[lang])) > STEP:
                    yield from count(lang)
    for lang in list(waiting):
        yield from count(lang)
    yield from (unpacked(lang, *kept) for lang, kept in held.items())


class Judge:
    """Distances of texts, given as their marked words one after the other, to fixed profiles."""

    def __init__(self, profiles: dict[str, dict[str, int]], size: int = SIZE) -> None:
        self.size, self.profiles = size, list(profiles.values())
        known = sorted({(packed(g), g) for p in self.profiles for g in p if max(map(ord, g)) < 1 << BITS})
        self.keys = np.array([k for k, _ in known] + [np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([[p.get(g, -1) for _, g in known] + [-1] for p in self.profiles], np.int64)

    def distances(self, marked: str) -> list[int] | None:
        if not marked:
            return None
        codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
        if codes.max() >= 1 << BITS:  # scripts beyond the first 4,096 characters
            own = ranking(Counter(marked[1:-1].split("__")), self.size)
            return [out_of_place(own, p, self.size) for p in self.profiles]
        ids, counts = counted_grams(codes)
        if len(ids) > self.size:
            least = np.partition(counts, len(counts) - self.size)[len(counts) - self.size]
            ids, counts = ids[counts >= least], counts[counts >= least]
        top = ids[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.keys, top)
        theirs = np.where(self.keys[at] == top, self.ranks[:, at], -1)
        return np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(top)))).sum(axis=1).tolist()


def distances(x: Column, profiles: dict[str, dict[str, int]], size: int = SIZE) -> Column:
    """The distance of a text column to every profile, as an array in the order of ``profiles``; null without letters."""

    @F.pandas_udf("array<long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Judge(profiles, size)
        for part in parts:
            yield pd.Series([judge.distances(marked) for marked in part], dtype=object)

    return run(marked_words(x))


def _loaded(profiles: DataFrame | dict[str, dict[str, int]] | None, size: int) -> dict[str, dict[str, int]]:
    if profiles is None:
        return shipped_profiles(size)
    if isinstance(profiles, dict):
        return profiles
    out: dict[str, dict[str, int]] = {}
    for r in profiles.where(F.col("rank") < size).orderBy("lang", "rank").collect():  # ``size`` rows a language
        out.setdefault(r.lang, {})[r.gram] = r["rank"]
    return out


def detect_language(df: DataFrame, column: str, out_col: str | None = None, profiles: DataFrame | dict[str, dict[str, int]] | None = None, distance_col: str | None = None, size: int = SIZE) -> DataFrame:
    """``out_col`` (by default ``<column>_lang``): the language of the nearest profile; ``distance_col``, if named: its distance.

    ``profiles``: what ``learn_profiles`` gives; by default the shipped ones.
    """
    known = _loaded(profiles, size)
    name, far = out_col or f"{column}_lang", fresh_name(df, "distances")
    if not known:
        return df.withColumn(name, F.lit(None).cast("string"))
    least = F.array_min(far)
    found = df.withColumn(far, distances(col(column), known, size))
    names = F.array(*[F.lit(k) for k in known])
    new = {name: F.when(F.col(far).isNotNull(), F.element_at(names, F.array_position(F.col(far), least).cast("int")))}
    if distance_col:
        new[distance_col] = least
    return found.withColumns(new).drop(far)


def filter_by_language(df: DataFrame, column: str, keep: str = "en", profiles: DataFrame | dict[str, dict[str, int]] | None = None) -> DataFrame:
    name = fresh_name(df, "language")
    return detect_language(df, column, name, profiles).where(F.col(name) == keep).drop(name)
