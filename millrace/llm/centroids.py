"""Centroid clustering in exact integers, screened by block norms.

A vector x becomes integers, floor(64 x) of each component, and is stored once with its compressed form: codes of ``2 * LEVELS + 1``
levels that give an approximation y, and the norms of the segments (``SEGMENT`` components each) of what is left, r = x - y. By the
Cauchy-Schwarz inequality, segment by segment, r.c is at most the sum of |r_s||c_s|, so the squared distance to a centroid c is at least
|x|^2 + |c|^2 - 2 (y.c + sum of |r_s||c_s|). Each vector gets its exact distance to the centroid of the least such bound; centroids whose
bound lies above that are pruned, and only the others receive exact integer distances. Bounds are lowered by more than their rounding,
so no nearest centroid is lost, and ties are settled by exact distances alone.

A round is one pass over the stored vectors. Tasks return a count and sums for each cluster, which Spark adds: whatever the size and
however many vectors are equal, the driver receives one row a cluster. Centroids (``k`` vectors) are what is broadcast.

Defined cases: vectors that are null, of another length, or hold a null or a value that is not finite are left out; a component whose
integer is beyond 2**27 raises an error, since distances must fit a long; null ids are clustered but give no start; repeated ids and
equal vectors are clustered row by row; equal distances go to the smaller centroid, equal start hashes to the smaller vector;
fewer vectors than ``k`` give as many centroids; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Components of a segment, codes to either side of zero, and the largest integer of a component.
SEGMENT, LEVELS, LARGEST = 4, 7, 1 << 27
#: Vectors compared at once: what a task holds.
TOGETHER = 4096
#: By how much of |x|^2 + |c|^2 a bound is lowered: far more than what its sums can lose in rounding.
ROUNDING = 1e-9


def segment_norms(x: np.ndarray) -> np.ndarray:
    """Norms of the segments of integer vectors, one row each; the last segment may be shorter."""
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, np.arange(0, x.shape[1], SEGMENT), axis=1))


@dataclass
class Vectors:
    """Integer vectors, one a row, and their compressed form."""

    x: np.ndarray
    step: np.ndarray
    codes: np.ndarray
    norms: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Vectors:
        """Steps by the largest component; norms are rounded up to 32 bits."""
        step = np.maximum(1, -(-np.abs(x).max(axis=1) // LEVELS))
        codes = np.rint(x / step[:, None]).astype(np.int8)
        norms = segment_norms(x - step[:, None] * codes.astype(np.int64))
        return Vectors(x, step, codes, np.nextafter(norms.astype(np.float32), np.float32(np.inf)))


@dataclass
class Centres:
    """Centroids, and what their bounds need."""

    c: np.ndarray
    norms: np.ndarray
    squares: np.ndarray

    @staticmethod
    def of(c: np.ndarray) -> Centres:
        return Centres(c, segment_norms(c), (c.astype(np.float64) ** 2).sum(axis=1))


def lower_bounds(v: Vectors, centres: Centres) -> np.ndarray:
    """For every vector and centroid a number that the squared distance surely reaches."""
    squares = (v.x.astype(np.float64) ** 2).sum(axis=1)[:, None] + centres.squares
    near = v.step[:, None] * (v.codes.astype(np.float64) @ centres.c.T.astype(np.float64))
    return squares * (1 - ROUNDING) - 2 * (near + v.norms.astype(np.float64) @ centres.norms.T)


def exact_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows."""
    gap = x - centres
    return np.einsum("ij,ij->i", gap, gap)


def nearest(v: Vectors, centres: Centres) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of every vector (ties: the smaller number), its squared distance, and how many exact distances that took."""
    bounds = lower_bounds(v, centres)
    each, first = np.arange(len(v.x)), bounds.argmin(axis=1)
    found = np.full(bounds.shape, np.iinfo(np.int64).max)
    found[each, first] = known = exact_distances(v.x, centres.c[first])
    left = bounds <= known[:, None]
    left[each, first] = False
    rows, numbers = np.nonzero(left)
    for a in range(0, len(rows), TOGETHER):
        r, c = rows[a : a + TOGETHER], numbers[a : a + TOGETHER]
        found[r, c] = exact_distances(v.x[r], centres.c[c])
    best = found.argmin(axis=1)
    return best, found[each, best], len(each) + len(rows)


def compressed(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``id``, ``x`` (integers) and the compressed form (``step``, ``codes``, ``norms``) of every whole vector of ``df``."""
    value = F.col(vec_col)
    whole = (F.size(value) == dims) & F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    src = df.where(value.isNotNull() & whole).select(F.col(id_col).alias("id"), value.cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component's integer is beyond {LARGEST}: exact distances would not fit")
            v = Vectors.of(x.astype(np.int64))
            codes = pa.array([row.tobytes() for row in v.codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(v.x.astype(np.int32)), pa.array(v.step.astype(np.int32)), codes, _lists(v.norms)], names=["id", *FORM])

    return src.mapInArrow(run, f"id {src.schema[0].dataType.simpleString()}, x array<int>, step int, codes binary, norms array<float>")


#: Columns of a stored vector.
FORM = ["x", "step", "codes", "norms"]


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Vectors]]:
    """Blocks of stored vectors, ``TOGETHER`` at most."""
    for batch in batches:
        for a in range(0, len(batch), TOGETHER):
            part = batch.slice(a, TOGETHER)
            x, step, codes, norms = (part.column(part.schema.get_field_index(c)) for c in FORM)
            rows = lambda values: values.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)  # noqa: B023, E731
            codes = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(part), -1)
            yield part, Vectors(rows(x).astype(np.int64), step.to_numpy(zero_copy_only=False).astype(np.int64), codes, rows(norms))


def starts(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``1:<id>``, in that order."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    rows = vectors.where("id is not null").select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def moved(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floors of means; those without vectors stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(Centres.of(centres))
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, v in _blocks(batches):
            best = nearest(v, shared.value)[0]
            counts += np.bincount(best, minlength=k)
            np.add.at(sums, best, v.x)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), _lists(sums[used])], names=["cluster", "n", "sums"])

    parts = vectors.select(FORM).mapInArrow(run, "cluster int, n long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.col("sums")[i]) for i in range(dims)]).collect()  # k rows at most
    out = centres.copy()
    for row in rows:
        out[row[0]] = [s // row[1] for s in row[2:]]
    return out


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``id``, ``cluster``, ``distance`` and ``compared`` (exact distances that were needed for its block, on the block's first row)."""
    shared = vectors.sparkSession.sparkContext.broadcast(Centres.of(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _blocks(batches):
            best, far, compared = nearest(v, shared.value)
            needed = np.zeros(len(part), np.int64)
            needed[:1] = compared
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int32()), pa.array(far, pa.int64()), pa.array(needed)], names=["id", "cluster", "distance", "compared"])

    return vectors.mapInArrow(run, f"id {vectors.schema[0].dataType.simpleString()}, cluster int, distance long, compared long")


@dataclass
class Clustering:
    """Final centroids, every vector's ``id``, ``cluster`` and ``distance``, distances summed by cluster, and the share of exact
    distances that screening saved in the last pass."""

    centres: np.ndarray
    members: DataFrame
    inertia: dict[int, int]
    pruned: float


def cluster(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> Clustering:
    """``rounds`` of assigning and moving from the ``starts``, then a last assignment."""
    vectors = materialise(compressed(df, vec_col, id_col, dims, scale), "centroid-vectors")
    centres = starts(vectors, k)
    if not len(centres):
        centres = np.zeros((0, dims), np.int64)
        return Clustering(centres, vectors.where("id is not null").selectExpr("id", "0 as cluster", "0L as distance"), {}, 0.0)
    for _ in range(rounds):
        centres = moved(vectors, centres)
    members = materialise(assigned(vectors, centres), "centroid-members")
    rows = members.groupBy("cluster").agg(F.sum("distance").alias("inertia"), F.count("*").alias("n"), F.sum("compared").alias("compared")).collect()
    pairs = len(centres) * sum(r.n for r in rows)
    return Clustering(centres, members.select("id", "cluster", "distance"), {r.cluster: r.inertia for r in rows}, 1 - sum(r.compared for r in rows) / pairs)


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centres.tolist()]
    table = spark.createDataFrame([(c, n, digest[c]) for c, n in found.inertia.items()], "cluster int, cluster_inertia long, centroid_sha256 string")
    rows = found.members.withColumnRenamed("id", "vec_id").join(F.broadcast(table), "cluster")  # K rows
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(found.inertia.values())).cast("long").alias("inertia"), "centroid_sha256")


def _assigned_sql(turn: int) -> str:
    return f"""
a{turn} AS MATERIALIZED (
    SELECT r, min_by(k, (d, k)) AS k, min(d) AS d, any_value(x) AS x
    FROM (SELECT v.r, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{turn} c)
    GROUP BY r)"""


def _moved_sql(turn: int) -> str:
    return f"""
m{turn} AS (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x
    FROM (SELECT k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{turn - 1}, range(1, {DIMS + 1}) t(i) GROUP BY k, i)
    GROUP BY k),
c{turn} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{turn - 1} c LEFT JOIN m{turn} m ON c.k = m.k)"""


ORACLE = f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x
    FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMS}),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x
    FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {K})),
{",".join(_assigned_sql(t) + "," + _moved_sql(t + 1) for t in range(ROUNDS))},{_assigned_sql(ROUNDS)}
SELECT v.vec_id, a.k::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia,
    sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v ON v.r = a.r JOIN c{ROUNDS} c ON c.k = a.k
"""
