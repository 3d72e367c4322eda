"""Importance resampling towards a target distribution, through a dictionary of distinct features.

Features are runs of one and two words. They are counted globally as strings, each distinct string is hashed to its bucket once, bucket
counts of the documents and of the target texts give a gain for each bucket, and gains come back to the documents' feature counts
through the dictionary. A document's weight is the floored mean of its features' gains; Gumbel noise from a hash of its id turns
drawing without replacement by weight into taking the highest scores.

What is exchanged is small, because a task first folds its documents to chunks (``CHUNK_BYTES`` of text): a feature crosses the network
once a chunk, however often and in however many of its documents it occurs, so the most common feature has no more rows than there are
chunks. Features of a chunk travel in compressed lists, one for each part of the dictionary; a part merges the lists of all
chunks, hashes its distinct strings, sums bucket counts and answers every list with the buckets of its features, in order. Answers
meet the chunk's documents again, which hold their words as numbers. Nothing but the ``BUCKETS`` gains is broadcast or passes the driver.

Chunks are made twice (for the lists, then for the documents) rather than stored: the same rows in the same order give the same
chunks, known by their first row's place, and answers that do not fit a chunk raise an error.

Defined cases: null and empty texts, and texts without words, have no features and weight 0; very long texts are taken whole (a chunk of
their own); repeated rows and repeated ids are weighed and drawn row by row, ties by id, then by place; null ids have a weight but no
score and are not drawn; without target texts all target counts are 0; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh_name, materialise, numbered, small_batches, text_or_empty

BUCKETS, SHARE, LEAST_WORDS = 10_000, 25, 20
#: Bytes of text of a chunk, and of all texts for each part of the dictionary: what one task holds.
CHUNK_BYTES, PART_BYTES = 16 << 20, 16 << 20
#: Words in the bytes of a text whose A-Z are lower-cased (fixed pattern; all bytes of other characters are 128 or more).
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, first all lowest bytes, then all second ones, and so on: high bytes hardly vary, and pack well."""
    return _packed(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Chunk:
    """Documents with their words as numbers, in order of first appearance."""

    def __init__(self, key: tuple[int, int], id_type: pa.DataType) -> None:
        self.key, self.id_type, self.size = key, id_type, 0
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.ids: list = []
        self.tokens: list[np.ndarray] = []

    def add(self, doc_id: object, raw: bytes) -> None:
        words = self.words
        self.ids.append(doc_id)
        self.tokens.append(np.array([words[w] for w in WORDS(raw.lower())], np.uint32))
        self.size += len(raw)

    def word_hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh32_intdigest, self.words), np.uint64, len(self.words))


class Features:
    """The distinct features of a chunk: its words, then its pairs in order of their words' numbers; and how they are dealt to parts."""

    def __init__(self, tokens: list[np.ndarray], hashes: np.ndarray, parts: int) -> None:
        lengths = np.array([len(t) for t in tokens], np.int64)
        flat = np.concatenate(tokens).astype(np.int64) if tokens else np.zeros(0, np.int64)
        self.vocabulary = max(1, len(hashes))
        opens = np.ones(len(flat), bool)  # no pair ends where a text begins
        opens[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        self.second = np.flatnonzero(opens)
        codes = flat[self.second - 1] * self.vocabulary + flat[self.second]
        self.pairs, self.pair_of, self.pair_counts = np.unique(codes, return_inverse=True, return_counts=True)
        self.flat, self.lengths = flat, lengths
        self.word_counts = np.bincount(flat, minlength=len(hashes)).astype(np.int64)
        with np.errstate(over="ignore"):
            pair_hash = (hashes[self.pairs // self.vocabulary] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[self.pairs % self.vocabulary]) * np.uint64(0xD6E8FEB86659FD93)
            mixed = np.concatenate([hashes * np.uint64(0x9E3779B97F4A7C15), pair_hash]) >> np.uint64(32)
        part = (mixed % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        self.edges = np.searchsorted(part[self.order], np.arange(parts + 1))
        self.counts = np.concatenate([self.word_counts, self.pair_counts])

    def strings(self, words: list[bytes], chosen: np.ndarray) -> list[bytes]:
        single = chosen[chosen < len(words)].tolist()
        pairs = self.pairs[chosen[len(single) :] - len(words)]
        return [words[i] for i in single] + [words[a] + b" " + words[b] for a, b in zip((pairs // self.vocabulary).tolist(), (pairs % self.vocabulary).tolist())]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Chunk]:
    """Chunks of the rows (``id``, ``file``, ``place``, ``text``) of a task."""
    chunk = None
    for batch in batches:
        for doc_id, file, place, text in zip(*batch.columns):
            chunk = chunk or Chunk((file.as_py(), place.as_py()), batch.column(0).type)
            chunk.add(doc_id.as_py(), text.as_py().encode())
            if chunk.size >= size:
                yield chunk
                chunk = None
    if chunk:
        yield chunk


LISTS = "part int, file long, place long, target boolean, features binary, counts binary"


def feature_lists(rows: DataFrame, parts: int, target: bool, size: int = CHUNK_BYTES) -> DataFrame:
    """For every chunk and part the chunk's distinct features there, and how often each occurs in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size):
            words = list(chunk.words)
            found = Features(chunk.tokens, chunk.word_hashes(), parts)
            for part in range(parts):
                chosen = found.order[found.edges[part] : found.edges[part + 1]]
                if not len(chosen):
                    continue
                lists = [_packed(b"\n".join(found.strings(words, chosen))), _planes(found.counts[chosen])]
                values = [[part], [chunk.key[0]], [chunk.key[1]], [target], *[[x] for x in lists]]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["part", "file", "place", "target", "features", "counts"])

    return rows.mapInArrow(run, LISTS)


ANSWERS = "part int, file long, place long, buckets binary, s array<long>, t array<long>"


def dictionary(lists: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Merges each part's lists. One row answers a list with the buckets of its features; one row a part has its bucket counts ``s``
    (documents) and ``t`` (target)."""

    def run(table: pa.Table) -> pa.Table:
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        read = []
        for part, file, place, target, features, counts in zip(*(table.column(c).to_pylist() for c in ("part", "file", "place", "target", "features", "counts"))):
            at = np.array([index[f] for f in _unpacked(features).split(b"\n")], np.int32)
            read.append((part, file, place, target, at, _numbers(counts)))
        bucket = np.fromiter((zlib.crc32(f) % buckets for f in index), np.uint16 if buckets <= 1 << 16 else np.uint32, len(index))
        sums = np.zeros((2, buckets), np.int64)
        out = []
        for part, file, place, target, at, counts in read:
            np.add.at(sums[int(target)], bucket[at], counts.astype(np.int64))
            if not target:
                out.append((part, file, place, _packed(bucket[at].tobytes()), None, None))
        out.append((read[0][0], None, None, None, sums[0], sums[1]))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["part", "file", "place", "buckets", "s", "t"])

    return lists.groupBy("part").applyInArrow(run, ANSWERS)


def bucket_gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every one of the B buckets."""
    b, all_s, all_t = len(s), int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log(float(y + 1) * float(all_s + b) / (float(x + 1) * float(all_t + b)))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def _summed(answers: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over all parts: ``buckets`` rows come to the driver, whatever the size."""
    each = answers.where("s is not null").select(F.posexplode(F.arrays_zip("s", "t")).alias("bucket", "n"))
    out = np.zeros((2, buckets), np.int64)
    for row in each.groupBy("bucket").agg(F.sum("n.s").alias("s"), F.sum("n.t").alias("t")).collect():
        out[:, row.bucket] = row.s, row.t
    return out[0], out[1]


def _weights(rows: DataFrame, answers: DataFrame, gains: np.ndarray, parts: int, id_col: str, size: int = CHUNK_BYTES) -> DataFrame:
    """``id_col``, ``n_features`` and ``weight`` of every row: its chunk's answers joined back to its features."""
    shared = rows.sparkSession.sparkContext.broadcast(gains)
    id_type = rows.schema["id"].dataType.simpleString()
    kind = np.uint16 if len(gains) <= 1 << 16 else np.uint32

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size):
            lengths = np.array([len(t) for t in chunk.tokens], np.uint32)
            values = [[chunk.key[0]], [chunk.key[1]], [_planes(lengths)], [_planes(np.concatenate(chunk.tokens))], [chunk.word_hashes().astype("<u4").tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*[pa.array(v, k) for v, k in zip(values, kinds)], pa.array([chunk.ids], pa.list_(chunk.id_type))], names=["file", "place", "lengths", "tokens", "hashes", "ids"])

    def joined(chunk: pa.Table, lists: pa.Table) -> pa.Table:
        lengths, tokens = (_numbers(chunk.column(c)[0].as_py()) for c in ("lengths", "tokens"))
        hashes = np.frombuffer(chunk.column("hashes")[0].as_py(), "<u4").astype(np.uint64)
        found = Features(np.split(tokens, np.cumsum(lengths.astype(np.int64))[:-1]), hashes, parts)
        order = np.argsort(lists.column("part").to_numpy())
        answer = [np.frombuffer(_unpacked(lists.column("buckets")[int(i)].as_py()), kind) for i in order]
        given = lists.column("part").to_numpy()[order].tolist()
        if given != np.flatnonzero(np.diff(found.edges)).tolist() or [len(a) for a in answer] != [n for n in np.diff(found.edges).tolist() if n]:
            raise RuntimeError("the answers do not fit the chunk: its rows were read in another order")
        gain = np.empty(len(found.order), np.int64)
        gain[found.order] = shared.value[np.concatenate(answer)] if answer else 0
        words = len(hashes)
        of_token = gain[:words][found.flat]
        of_token[found.second] += gain[words:][found.pair_of]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        sums = np.zeros(len(lengths), np.int64)
        np.add.at(sums, owner, of_token)
        n = np.maximum(2 * found.lengths - 1, 0)
        return pa.Table.from_arrays([chunk.column("ids").combine_chunks().flatten(), pa.array(n, pa.int64()), pa.array(sums // np.maximum(n, 1), pa.int64())], names=[id_col, "n_features", "weight"])

    docs = rows.mapInArrow(documents, f"file long, place long, lengths binary, tokens binary, hashes binary, ids array<{id_type}>")
    lists = answers.where("buckets is not null").select("file", "place", "part", "buckets")
    return docs.groupBy("file", "place").cogroup(lists.groupBy("file", "place")).applyInArrow(joined, f"`{id_col}` {id_type}, n_features long, weight long")


def _rows(df: DataFrame, text_col: str, id_col: str | None, name: str) -> DataFrame:
    keyed, key = numbered(df, name)
    doc_id = F.col(id_col) if id_col else F.lit(None).cast("long")
    return keyed.select(doc_id.alias("id"), F.col(f"{key}.file").alias("file"), F.col(f"{key}.place").alias("place"), text_or_empty(text_col).alias("text"))


def weigh(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", buckets: int = BUCKETS, part_bytes: int = PART_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``id_col``, ``n_features`` and ``weight`` of every document, written out. ``target`` needs ``text_col`` only."""
    small_batches(docs.sparkSession)
    own, aimed = _rows(docs, text_col, id_col, "importance-docs"), _rows(target, text_col, None, "importance-target")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // part_bytes
    lists = feature_lists(own, parts, False, chunk_bytes).unionAll(feature_lists(aimed, parts, True, chunk_bytes))
    answers = materialise(dictionary(lists, buckets), "importance-answers")
    return materialise(_weights(own, answers, bucket_gains(*_summed(answers, buckets)), parts, id_col, chunk_bytes), "importance-weights")


def ranked(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``scored`` rows with their ``rank`` by falling ``score`` (1, 2, ...; ties by ``id_col``, then by place): a range sort, whose
    partitions are numbered by their sizes, so no task holds more than its range, however many rows are equal."""
    place = fresh_name(scored, "place")
    rows = materialise(scored.withColumn(place, F.monotonically_increasing_id()), "importance-scores")
    order = [F.col("score").desc(), F.col(id_col), F.col(place)]
    at = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "importance-order")
    part = F.shiftright(place, 33)
    sizes = sorted((r.part, r.n) for r in at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    starts, so_far = [], 0
    for number, n in sizes:
        starts.append((number, so_far))
        so_far += n
    table = scored.sparkSession.createDataFrame(starts, "_part long, _start long")
    joined = at.join(F.broadcast(table), part == F.col("_part"))
    return joined.select(*scored.columns, (F.col("_start") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))


def resample(weights: DataFrame, id_col: str = "doc_id", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = 7) -> DataFrame:
    """``weights`` with ``score`` (weight and Gumbel noise from the id) and ``rank`` of the drawn rows: of the rows with ``least_words``
    or more, ``share`` in a hundred of highest score."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weights.withColumn("score", F.col("weight") + noise)
    enough = F.col("n_features") >= 2 * least_words - 1
    drawn = share * weights.where(enough).count() // 100
    able = enough & F.col("score").isNotNull()
    first = ranked(scored.where(able), id_col)
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionAll(rest)


def op13_importance(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(weigh(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 of texts in SQL: the table of its bytes, and a fold over the bytes of each distinct feature.
ORACLE = f"""
WITH RECURSIVE steps AS (
    SELECT range AS b, 0 AS turn, range::BIGINT AS r FROM range(256)
    UNION ALL
    SELECT b, turn + 1, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END FROM steps WHERE turn < 8),
crc AS MATERIALIZED (SELECT list(r ORDER BY b) AS t FROM steps WHERE turn = 8),
texts AS (
    SELECT row_number() OVER () AS r, doc_id, text, false AS target FROM documents
    UNION ALL SELECT -row_number() OVER (), NULL, text, true FROM benchmark),
words AS MATERIALIZED (
    SELECT r, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM texts),
features AS MATERIALIZED (
    SELECT r, target, f, count(*) AS n
    FROM (SELECT r, target, unnest(w) AS f FROM words
        UNION ALL SELECT r, target, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM words WHERE len(w) > 1)
    GROUP BY r, target, f),
hashed AS MATERIALIZED (
    SELECT f, xor(list_reduce(list_transform(range(1, 2 * strlen(f) + 1, 2), lambda i: ('0x' || substr(hex(encode(f)), i, 2))::BIGINT),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
    FROM (SELECT DISTINCT f FROM features), crc),
counts AS (
    SELECT bucket, sum(n) FILTER (NOT target) AS s, sum(n) FILTER (target) AS t FROM features JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM counts),
gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {BUCKETS}))))::BIGINT AS g
    FROM counts, totals),
sums AS (SELECT r, sum(n * g)::BIGINT AS g FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE NOT target GROUP BY r),
weights AS (
    SELECT r, doc_id, greatest(2 * len(w) - 1, 0)::BIGINT AS n_features,
        CASE WHEN len(w) = 0 THEN 0 ELSE (g - ((g % (2 * len(w) - 1)) + 2 * len(w) - 1) % (2 * len(w) - 1)) // (2 * len(w) - 1) END::BIGINT AS weight
    FROM words LEFT JOIN sums USING (r) WHERE NOT target),
scored AS (
    SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id::VARCHAR)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weights),
placed AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank FROM scored
    WHERE n_features >= {2 * LEAST_WORDS - 1} AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score,
    CASE WHEN rank <= {SHARE} * (SELECT count(*) FROM weights WHERE n_features >= {2 * LEAST_WORDS - 1}) // 100 THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN placed USING (r)
"""
