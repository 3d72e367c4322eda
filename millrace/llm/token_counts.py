"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens over whose edges the vocabulary has no merge: runs of spaces (or of line feeds) with what follows
them. Its count is the sum of its pre-tokens' lengths in tokens, which are looked up in two tiers: a compact table of the frequent
ones, broadcast, and behind it each worker's own cache, whose misses the library encodes. No pre-token is shuffled.

The table's entries are the frequent pre-tokens of all documents. Every task keeps a summary of bounded size over all its texts
(Misra and Gries: a pre-token that makes up more than 1 / ``FREQUENT`` of a task's is surely in it), and the summaries, one row a
task, are merged ``FAN_IN`` by ``FAN_IN`` under the same rule. Which entries the table has decides on speed alone, never on a count.

A vocabulary is cut only where that is safe: texts are taken as they are (no normalisation but a space in front), no piece
holds a space behind anything else, and line feeds cut only if no piece holds one. Otherwise whole texts are encoded.

Defined cases: a null text is an empty text, which has no tokens; very long texts are counted whole, a very long pre-token is encoded
as one and not cached; repeated rows, rows of one id and null ids are counted row by row; ties among frequent pre-tokens go by the
text; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, resident, small_batches, text_or_empty

VOCABULARY = "piece_bpe_32k.model"
#: Entries of the broadcast table, the longest of them in characters, and the tokens of a text that is over the limit.
FREQUENT, LONGEST, LIMIT = 32_768, 64, 4096
#: Summaries merged at once.
FAN_IN = 32
#: Entries in each of the two generations of a worker's cache.
CACHE_ENTRIES = 100_000
#: The mark that stands for a space inside pieces (fixed value).
MARK = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def cutting_pattern(processor: sentencepiece.SentencePieceProcessor) -> str | None:
    """A pattern that finds the pre-tokens of ``" " + text``, or None if the vocabulary allows no cuts."""
    probe = "  ﬁ  Å　 \t\r\n x  "
    if processor.normalize(probe) != MARK + probe.replace(" ", MARK):
        return None
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size()) if not processor.is_control(i) and not processor.is_unknown(i)]
    if MARK not in pieces or any(MARK in p.lstrip(MARK) for p in pieces):
        return None
    return " +[^ ]*" if any("\n" in p for p in pieces) else " +[^ \n]*|\n+[^ \n]*"


class Lengths:
    """Lengths of pre-tokens: the frequent ones from a table, the others cached or encoded.

    A pre-token is named by what follows its first space, or by all of it if it begins with a line feed.
    """

    def __init__(self, path: str, table: tuple[bytes, bytes] | None = None) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pattern = cutting_pattern(self.processor)
        self.find = re.compile(pattern).findall if pattern else None
        self.at_lines = bool(pattern and "\n" in pattern)
        self.table: dict[str, int] = unpacked(*table) if table else {}
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.encoded = 0

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text; an empty text has none."""
        if not text or not self.find:
            return []
        text = text.replace(MARK, " ")
        cut = text.replace("\n", " \n") if self.at_lines else text
        if "  " not in cut and cut[0] != " " and cut[-1] != " ":
            return cut.split(" ")
        return [p[1:] if p[0] == " " else p for p in self.find(" " + text)]

    def encode(self, pieces: list[str]) -> list[int]:
        """Lengths of distinct pre-tokens. The library puts a mark before what it encodes: that is a pre-token's first space, and one
        token too many before a line feed."""
        self.encoded += len(pieces)
        found = self.processor.encode(pieces, num_threads=1)
        return [len(ids) - 1 if self.at_lines and p[:1] == "\n" else (len(ids) or 1) for p, ids in zip(pieces, found)]

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        if not self.find:
            return len(self.processor.encode(text))
        pieces = self.pieces(text)
        found = list(map(self.table.get, pieces))
        if None not in found:
            return sum(found)
        total = sum(n for n in found if n is not None)
        missed = Counter(p for p, n in zip(pieces, found) if n is None)
        return total + self._second(missed)

    def _second(self, missed: Counter) -> int:
        total, new = 0, []
        for p, times in missed.items():
            n = self.cache.get(p) or self.older.get(p)
            if n is None:
                new.append(p)
            else:
                total += n * times
        if new:
            if len(self.cache) > CACHE_ENTRIES:
                self.older, self.cache = self.cache, {}
            for p, n in zip(new, self.encode(new)):
                total += n * missed[p]
                if len(p) <= LONGEST:
                    self.cache[p] = n
        return total


def packed(table: dict[str, int]) -> tuple[bytes, bytes]:
    """Pre-tokens one after the other, each ended by a zero character, and their numbers (eight bytes each)."""
    return "".join(p + "\0" for p in table).encode(), np.array(list(table.values()), "<i8").tobytes()


def unpacked(keys: bytes, values: bytes) -> dict[str, int]:
    return dict(zip(keys.decode().split("\0"), np.frombuffer(values, "<i8").tolist()))


def shrunk(counts: Counter, size: int) -> Counter:
    """The ``size`` most frequent (ties by text), less what the next one has: the rule that keeps merged summaries within their bound."""
    if len(counts) <= size:
        return counts
    order = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    least = order[size][1]
    return Counter({p: n - least for p, n in order[:size] if n > least})


def _summary(part: int, counts: Counter, size: int) -> pa.RecordBatch:
    keys, values = packed(shrunk(Counter({p: n for p, n in counts.items() if "\0" not in p}), size))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([keys], pa.binary()), pa.array([values], pa.binary())], names=["part", "keys", "counts"])


def _summaries(texts: DataFrame, path: str, size: int) -> DataFrame:
    """One row a task: the frequent pre-tokens of its texts, with what is left of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resident(("token-lengths", path), lambda: Lengths(path))
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                pieces = own.pieces(text.as_py())
                counts.update(pieces if len(max(pieces, key=len, default="")) <= LONGEST else [p for p in pieces if len(p) <= LONGEST])
            if len(counts) > 8 * size:
                counts = shrunk(counts, size)
        yield _summary(TaskContext.get().partitionId(), counts, size)

    return texts.mapInArrow(run, "part long, keys binary, counts binary")


def frequent(df: DataFrame, text_col: str = "text", path: str | None = None, size: int = FREQUENT) -> list[str]:
    """The frequent pre-tokens of all texts, ``size`` at most."""
    small_batches(df.sparkSession)
    path = path or default_path()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        part = 0
        for batch in batches:
            for at, keys, values in zip(*(c.to_pylist() for c in batch.columns)):
                counts.update(unpacked(keys, values))
                counts, part = shrunk(counts, size), at // FAN_IN
        yield _summary(part, counts, size)

    parts = materialise(_summaries(df.select(text_or_empty(text_col).alias("text")), path, size), "token-summaries")
    while parts.count() > FAN_IN:
        groups = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(lambda t: pa.Table.from_batches(merge(t.to_batches())), "part long, keys binary, counts binary")
        parts = materialise(groups, "token-summaries")
    counts: Counter = Counter()
    for row in parts.orderBy("part").collect():  # FAN_IN rows at most
        counts.update(unpacked(bytes(row["keys"]), bytes(row["counts"])))
    return list(shrunk(counts, size))


def count_tokens(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, table: list[str] | None = None) -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` of every text; ``table``: the frequent pre-tokens, by default those of ``df``.

    The vocabulary file must be readable on every executor.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = path or default_path()
    known = frequent(df, text_col, path) if table is None else table
    lengths = Lengths(path)
    shared = spark.sparkContext.broadcast(packed(dict(zip(known, lengths.encode(known)))) if known and lengths.find else None)
    name = f"{path}:{id(shared)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resident(("token-lengths", name), lambda: Lengths(path, shared.value))
        for batch in batches:
            counts = pa.array([own.count(text.as_py()) for text in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=[id_col, "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    src = df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
