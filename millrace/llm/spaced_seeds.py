"""Benchmark decontamination by spaced-seed hashing.

A fixed mask of care and ignore positions is slid over the tokens of test items and of documents; the hash of the care
positions is the same whatever stands at the ignored ones, so a substituted word does not hide a passage. Every mask takes
five words. Equal hashes give an alignment (document position minus item position), and the aligned tokens around the hit
are compared: an overlap of ``similarity`` or more of the item's tokens is contamination.

Plan: documents are hashed where they are read; a Bloom filter of fixed size, made of all test hashes, leaves only hits; a
document gives a row for each region of hits with the region's tokens, never its whole text. Regions are written once and
joined to the test hashes on the hash in Spark, folded to alignments, then verified with array functions. Nothing is
collected but the filter's words, whose number is fixed.

Items longer than ``SEGMENT`` tokens are cut into overlapping segments of that length; one segment is enough.

In an item of fewer than ten words one changed word can break every mask. Such items get runs of neighbouring words besides: the
whole item if it has fewer than five words (none may change at this similarity), else both halves, of which one is left
whole by the one word that may change.

Defined cases: null and empty texts have no tokens and match nothing; equal items are reported each; repeated rows of one id
give one row for an item; rows with a null id share the null id; of equal overlaps the first in the text is reported; very
long texts are read whole; without documents or items there are no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, small_batches

#: Care (1) and ignore (0) positions; five words each.
MASKS = ("11111", "110111", "1110101", "1101011", "11001101")
SIMILARITY = 0.8
SEGMENT = 64
#: Bits of the Bloom filter, a power of two: 8 MB whatever the number of items.
FILTER_BITS = 26
#: Items of fewer tokens get runs as well; a run has at most four words.
FEW = 10
_TOKENS = re.compile(r"\w+")
_ODD = (np.random.default_rng(11).integers(1, 2**62, 2 * len(MASKS[0]) * len(MASKS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def token_hashes(text: str | None) -> np.ndarray:
    """crc32 of every lower-cased word."""
    words = " ".join(_TOKENS.findall((text or "").lower())).encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def seed_hashes(tokens: np.ndarray, masks: tuple[str, ...] = MASKS) -> Iterator[np.ndarray]:
    """For each mask the hashes at all positions where it fits; masks differ in their multipliers."""
    for m, mask in enumerate(masks):
        count = len(tokens) - len(mask) + 1
        if count <= 0:
            yield np.zeros(0, np.uint64)
            continue
        total = np.full(count, m + 1, np.uint64)
        for k, at in enumerate(i for i, c in enumerate(mask) if c == "1"):
            total += (tokens[at : at + count] + np.uint64(1)) * _ODD[5 * m + k]
        yield total ^ (total >> np.uint64(29))


def run_length(n: int) -> int:
    """Words in the runs of an item of ``n`` tokens (0: it has none)."""
    return n if n < 5 else n // 2 if n < FEW else 0


def run_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """The hashes of all runs of ``length`` neighbouring tokens."""
    count = len(tokens) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, 1000 + length, np.uint64)
    for k in range(length):
        total += (tokens[k : k + count] + np.uint64(1)) * _ODD[-1 - k]
    total *= _ODD[length]
    return total ^ (total >> np.uint64(29))


def segments(n: int, size: int = SEGMENT) -> list[tuple[int, int]]:
    """Bounds of the segments of an item of ``n`` tokens."""
    if n <= size:
        return [(0, n)]
    return [*((a, a + size) for a in range(0, n - size, size // 2)), (n - size, n)]


def item_segments(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item``, ``segment``, ``tokens`` and the seed hashes (``hashes``, ``positions``) of every segment of one token or more."""
    small_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0), batch.column(1)):
                whole = token_hashes(text.as_py())
                for k, (a, b) in enumerate(segments(len(whole))):
                    tokens = whole[a:b]
                    if len(tokens):
                        found = [(x, np.arange(len(x))) for x in seed_hashes(tokens)]
                        if length := run_length(len(tokens)):
                            ends = np.array([0, len(tokens) - length])
                            found.append((run_hashes(tokens, length)[ends], ends))
                        rows.append((item, k, tokens.astype(np.int64), np.concatenate([x for x, _ in found]).view(np.int64), np.concatenate([at for _, at in found])))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0].as_py() for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.int32()), *[pa.array([r[c] for r in rows], pa.list_(pa.int64())) for c in (2, 3, 4)]],
                    names=["item", "segment", "tokens", "hashes", "positions"],
                )

    src = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"item {src.schema[0].dataType.simpleString()}, segment int, tokens array<long>, hashes array<long>, positions array<long>")


def hash_filter(seeds: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter (two bits a hash) of the column ``hash``, as 64-bit words; built by a grouped ``bit_or``."""
    first = F.expr(f"shiftrightunsigned(hash, {64 - bits})")
    second = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    at = seeds.select(F.explode(F.array(first, second)).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    found = words.toPandas()  # at most 2**(bits - 6) rows
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _held(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def regions_of(tokens: np.ndarray, words: np.ndarray, bits: int = FILTER_BITS, runs: tuple[int, ...] = ()) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Start, tokens, hit hashes and hit positions (in the region) of every region of hits of one text; ``runs``: lengths of the
    runs that items have."""
    at, hashes = [], []
    for found in [*seed_hashes(tokens), *[run_hashes(tokens, n) for n in runs]]:
        hit = np.flatnonzero(_held(words, found >> np.uint64(64 - bits)))
        hit = hit[_held(words, found[hit] & np.uint64((1 << bits) - 1))]
        at.append(hit)
        hashes.append(found[hit])
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    if not len(at):
        return []
    order = np.argsort(at, kind="stable")
    at, hashes = at[order], hashes[order]
    cuts = np.flatnonzero(np.diff(at) > 2 * SEGMENT) + 1
    out = []
    for own, values in zip(np.split(at, cuts), np.split(hashes, cuts)):
        a, b = max(0, int(own[0]) - SEGMENT), min(len(tokens), int(own[-1]) + 2 * SEGMENT)
        out.append((a, tokens[a:b], values, own - a))
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and item that overlap: ``id_col``, ``item_col``, ``similarity`` (of the best segment),
    ``matched`` tokens, ``start`` (token of the document at which that segment begins) and ``seeds`` (hits that agree)."""
    spark = docs.sparkSession
    parts = materialise(item_segments(items, item_col, item_text), "seed-segments")
    seeds = parts.select("item", "segment", F.explode(F.arrays_zip("hashes", "positions")).alias("h"))
    seeds = seeds.groupBy(F.col("h.hashes").alias("hash"), "item", "segment").agg(F.min("h.positions").alias("item_at"))
    seeds = materialise(seeds, "seed-hashes")
    few = parts.select(F.size("tokens").alias("n")).where(F.col("n") < FEW).distinct().collect()  # fewer than ``FEW`` rows
    shared = spark.sparkContext.broadcast((hash_filter(seeds), tuple(sorted({run_length(r.n) for r in few}))))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        words, runs = shared.value
        for batch in batches:
            ids, rows = [], []
            for k, text in enumerate(batch.column(1)):
                found = regions_of(token_hashes(text.as_py()), words, runs=runs)
                rows += found
                ids += [k] * len(found)
            if rows:
                own = pa.array(range(number, number + len(rows)), pa.int64())
                number += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(ids)), own, pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[c].astype(np.uint64).view(np.int64) for r in rows], pa.list_(pa.int64())) for c in (1, 2, 3)]],
                    names=["doc", "region", "start", "tokens", "hashes", "positions"],
                )

    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    regions = src.mapInArrow(run, f"doc {src.schema[0].dataType.simpleString()}, region long, start long, tokens array<long>, hashes array<long>, positions array<long>")
    regions = materialise(regions, "seed-regions")
    hits = regions.select("region", F.explode(F.arrays_zip("hashes", "positions")).alias("h")).select("region", F.col("h.hashes").alias("hash"), F.col("h.positions").alias("doc_at"))
    aligned = hits.join(seeds, "hash").groupBy("region", "item", "segment", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.count("*").alias("seeds"))
    aligned = materialise(aligned, "seed-alignments")
    pairs = aligned.join(regions.select("region", "doc", "start", F.col("tokens").alias("doc_tokens")), "region")
    segment = parts.select(F.col("item").alias("of_item"), F.col("segment").alias("of_segment"), F.col("tokens").alias("item_tokens"))
    pairs = pairs.join(segment, F.col("item").eqNullSafe(F.col("of_item")) & (F.col("segment") == F.col("of_segment")))
    size = F.size("item_tokens")
    low = F.greatest(F.lit(0), -F.col("shift")).cast("int")
    high = F.least(size.cast("long"), F.size("doc_tokens") - F.col("shift")).cast("int")
    same = F.zip_with(
        F.slice("item_tokens", low + 1, F.greatest(high - low, F.lit(0))),
        F.slice("doc_tokens", (low + F.col("shift") + 1).cast("int"), F.greatest(high - low, F.lit(0))),
        lambda a, b: (a == b).cast("int"),
    )
    pairs = pairs.withColumn("matched", F.aggregate(same, F.lit(0), lambda total, x: total + x))
    pairs = pairs.withColumn("similarity", F.col("matched") / size).where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("similarity", "matched", (F.col("start") + F.col("shift")).alias("start"), "seeds"), F.struct("similarity", -(F.col("start") + F.col("shift")), "seeds"))
    return pairs.groupBy(F.col("doc").alias(id_col), F.col("item").alias(item_col)).agg(best.alias("b")).select(id_col, item_col, "b.similarity", "b.matched", "b.start", "b.seeds")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
