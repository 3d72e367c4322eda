"""Kinds of string columns, text preprocessing, spelling and profanity."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.automaton import Automaton, folded, longest_first
from millrace.functions.selectors import col, replaced, strings
from millrace.functions.stats import distinct_counts, first_row
from millrace.functions.storage import cut, fresh_names, small_batches

SAMPLE = 30


def detect_json_sample(samples: list[str]) -> bool:
    """Whether at least half of the samples are JSON objects or arrays."""

    def ok(s: str) -> bool:
        s = s.strip()
        if not (s.startswith("{") and s.endswith("}") or s.startswith("[") and s.endswith("]")):
            return False
        try:
            json.loads(s)
        except ValueError:
            return False
        return True

    n = sum(map(ok, samples))
    return n > 0 and n / len(samples) >= 0.5


def column_types(df: DataFrame) -> dict[str, dict]:
    """For each string column its type (``json``, ``categorical`` or ``text``) and the figures behind it."""
    names = strings(df)
    rows, distinct = distinct_counts(df, names)
    lengths = first_row(df, {c: F.avg(F.length(col(c))) for c in names})
    out = {}
    for c in names:
        sample = [r[0] for r in df.select(col(c)).where(col(c).isNotNull()).limit(SAMPLE).collect()]
        share = distinct[c] / rows if rows else 0
        is_json = detect_json_sample(sample) if sample else False
        kind = "json" if is_json else "categorical" if share < 0.2 or (distinct[c] < 50 and (lengths[c] or 0) < 20) else "text"
        out[c] = {"type": kind, "unique_ratio": round(share, 3), "avg_length": None if lengths[c] is None else round(lengths[c], 1), "unique_count": distinct[c], "is_json": is_json}
    return out


def detect_column_types_and_process_text(df: DataFrame, lemmatizer: Callable[[str], str] | None = None, **options) -> tuple[DataFrame, dict[str, dict]]:
    """The types of string columns, and the table with text columns preprocessed. ``lemmatizer`` maps a word to its lemma."""
    report = column_types(df)
    names = [c for c, r in report.items() if r["type"] == "text"]
    out = replaced(df, {c: text.preprocess_text(col(c), **options) for c in names})
    if lemmatizer:

        @F.pandas_udf("string")
        def lemmas(x: pd.Series) -> pd.Series:
            return x.map(lambda s: " ".join(map(lemmatizer, s.split())), na_action="ignore")

        out = replaced(out, {c: lemmas(col(c)) for c in names})
    return out, report


def preprocess_text_columns(df: DataFrame, columns: Iterable[str], **options) -> DataFrame:
    return replaced(df, {c: text.preprocess_text(col(c).cast("string"), **options) for c in columns if c in df.columns})


def _deletions(word: str, most: int) -> set[str]:
    """``word`` and what is left of it after up to ``most`` deletions."""
    found = step = {word}
    for _ in range(most):
        step = {w[:i] + w[i + 1 :] for w in step for i in range(len(w))}
        found = found | step
    return found


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours that turn ``a`` into ``b``."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, hit = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), hit
            if x == y:
                hit = j
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        last[x] = i
        rows.append(row)
    return rows[-1][-1]


def spelling_fixes(words: DataFrame, vocabulary: DataFrame, distance: int = 2) -> DataFrame:
    """``word`` and ``fixed`` of those distinct ``words`` (column ``word``) that ``vocabulary`` (``known``, ``n``) lacks but can mend.

    Two words within ``distance`` edits have a common form after up to as many deletions each; so the forms of both sides, as tables,
    are joined, and candidates verified. The nearest word wins, then the most frequent, then the last in order.
    """

    @F.pandas_udf("array<string>")
    def forms(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda w: sorted(_deletions(w, distance)))

    @F.pandas_udf("int")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(x, y) for x, y in zip(a, b)], dtype="int32")

    low = words.select(F.lower("word").alias("low")).distinct()
    lacking = cut(low.join(vocabulary.select(F.col("known").alias("low")), "low", "left_anti"))
    index = vocabulary.select("known", "n", F.explode(forms("known")).alias("form"))
    pairs = lacking.select("low", F.explode(forms("low")).alias("form")).join(index, "form").select("low", "known", "n").distinct()
    near = pairs.withColumn("d", edits("low", "known")).where(F.col("d") <= distance)
    best = near.groupBy("low").agg(F.max(F.struct((-F.col("d")).alias("d"), "n", "known")).alias("best"))
    return words.distinct().join(best, F.lower("word") == F.col("low")).select("word", F.col("best.known").alias("fixed"))


def correct_spelling_text(df: DataFrame, columns: Iterable[str], vocabulary: dict[str, int] | DataFrame, distance: int = 2) -> DataFrame:
    """Words that ``vocabulary`` lacks become its nearest word within ``distance`` edits, if there is one; white space becomes one blank.

    ``vocabulary``: word to frequency, or a table with the columns ``known`` and ``n`` of any size (lower case; it is joined, not broadcast).
    Nulls stay; words are compared in lower case, and known ones stay as they are.
    """
    if not isinstance(vocabulary, DataFrame):
        vocabulary = df.sparkSession.createDataFrame([(w, int(n)) for w, n in vocabulary.items()], "known string, n long")
    row, fixed = fresh_names(df, "row", "fixed")
    out = df
    for c in [c for c in columns if c in df.columns]:
        kept = out.columns
        rows = cut(out.withColumn(row, F.monotonically_increasing_id()))
        words = rows.select(row, F.posexplode(text.tokens(col(c).cast("string"))).alias("at", "word"))
        fixes = cut(spelling_fixes(words.select("word"), vocabulary, distance))
        mended = words.join(fixes, "word", "left").groupBy(row).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("fixed", "word").alias("word")))).alias("words"))
        texts = mended.select(row, F.array_join("words.word", " ").alias(fixed))
        whole = F.when(col(c).isNotNull(), F.coalesce(F.col(fixed), F.lit("")))
        out = rows.join(texts, row, "left").select(*[(whole if x == c else col(x)).alias(x) for x in kept])
    return out


class Censor:
    """Finds listed words: as whole words in any case, and (``disguised``) where look-alikes, marks between letters, spaced or drawn-out
    letters hide them. The list's size does not matter to the cost."""

    def __init__(self, words: Iterable[str], mask: str, disguised: bool) -> None:
        listed = [w for w in words if w.strip()]
        self.plain = Automaton(filter(None, (tuple(_WORD.findall(w.casefold())) for w in listed)))
        self.hidden = {f for w in listed for f in folded(w) if len(f) > 2} if disguised else set()
        self.mask = mask

    def spans(self, value: str) -> list[tuple[int, int]]:
        words = list(_WORD.finditer(value))
        found = [(words[a].start(), words[b - 1].end()) for a, b in self.plain.find([w.group().casefold() for w in words]) if all(value[x.end() : y.start()].isspace() for x, y in zip(words[a : b - 1], words[a + 1 : b]))]
        if self.hidden:
            chunks = [(m.start(), m.end()) for m in _CHUNK.finditer(value)]
            spaced: list[tuple[int, int]] = []
            for a, b in [*chunks, (len(value), len(value) + 2)]:
                if b - a == 1:
                    spaced.append((a, b))
                    continue
                if len(spaced) > 2 and folded(value[spaced[0][0] : spaced[-1][1]]) & self.hidden:
                    found.append((spaced[0][0], spaced[-1][1]))
                spaced = []
                end = a + len(value[a:b].rstrip("@$!|+"))  # marks at the end may be letters or just marks
                if b - a <= 64 and (not value[a:b].isalpha() or _DRAWN.search(value, a, b)):
                    found += [(a, e) for e in {b, end} if folded(value[a:e]) & self.hidden]
        return longest_first(found)

    def censor(self, value: str) -> str:
        for a, b in reversed(self.spans(value)):
            value = value[:a] + self.mask + value[b:]
        return value


_WORD, _CHUNK, _DRAWN = re.compile(r"\w+"), re.compile(r"[\w@$!|+](?:\S*[\w@$!|+])?"), re.compile(r"(\w)\1\1")


def redact_profanity(df: DataFrame, columns: Iterable[str], words: Iterable[str], replacement: str = "****", disguised: bool = True) -> DataFrame:
    """Listed words (whole, in any case; ``disguised``: written with look-alikes or marks too) become four times the first character of
    ``replacement``. Nulls stay."""
    small_batches(df.sparkSession)
    censor = Censor(words, (replacement[:1] or "*") * 4, disguised)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(censor.censor, na_action="ignore")

    return replaced(df, {c: run(col(c).cast("string")) for c in columns if c in df.columns})
