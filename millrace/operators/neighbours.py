"""Nearest neighbours over features that may be missing, through cells with bounding boxes.

The distance of two tuples goes over the features both have, scaled up to all. Tuples are dealt to cells around pivots, features
measured by their deviations (pivots are a bounded sample by hash; which tuples they are decides on speed alone). There is such an
index for each of the ``INDEXES`` most frequent sets of features that queries have, over these features, so that its cells are narrow in
them, and one over all features for the other queries. A cell is known by the least and the largest value of every
feature, the features that all or any of its tuples have, and how many have each; so a query has a lower bound of its distance to
everything in a cell. It first visits the cells nearest by that bound that hold ``k`` usable tuples, which gives the distance of
its k-th neighbour so far, and then only the cells whose bound does not exceed it: no nearer tuple, and no tie, is left out.

A visit is a join on the cell: blocks of tuples and groups of queries, both of bounded size, are compared in numpy. The table of cells is
what is broadcast (``CELLS`` rows an index at most, and as many for tuples with gaps). Distances are summed feature by feature without
cancellation, so a bound never exceeds a distance by rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.storage import cut

#: Indexes and cells of one at most, tuples of a block, and queries compared with a block at once.
INDEXES, CELLS, BLOCK, GROUP = 8, 2048, 1024, 256


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``y`` over the features both have, scaled up; infinite without any."""
    total, both = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        gap = x[:, j, None] - y[None, :, j]
        there = ~np.isnan(gap)
        total += np.where(there, gap * gap, 0.0)
        both += there
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(both > 0, total * (x.shape[1] / both), np.inf)


def ordered(x: np.ndarray) -> np.ndarray:
    """The order of tuples, feature by feature, missing values last."""
    return np.lexsort(x.T[::-1])


class Cells:
    """Boxes of the cells: ``low``, ``high`` and ``count`` for every feature, tuples (``size``) and their ``numbers``, which tell the index."""

    def __init__(self, numbers: list[int], low: np.ndarray, high: np.ndarray, count: np.ndarray, size: np.ndarray, sets: list[tuple[int, ...]]) -> None:
        self.numbers, self.low, self.high, self.count, self.size = np.array(numbers), low, high, count, size
        self.sets, self.index = sets, np.array(numbers, np.int64) // (2 * CELLS)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """A number that no distance of ``x`` to a tuple of the cell undercuts; infinite where no feature is shared, and in the indexes
        of other queries."""
        known = ~np.isnan(x)
        features = tuple(np.flatnonzero(known).tolist())
        own = self.index == (self.sets.index(features) if features in self.sets else len(self.sets) - 1)
        everywhere = (self.count == self.size[:, None]) & known
        most = ((self.count > 0) & known).sum(axis=1)
        total = np.zeros(len(self.size))
        for j in np.flatnonzero(known):
            gap = np.maximum(np.maximum(self.low[:, j] - x[j], x[j] - self.high[:, j]), 0.0)
            total += np.where(everywhere[:, j], gap * gap, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(own & (most > 0), total * (len(x) / most), np.inf)

    def first(self, x: np.ndarray, gaps: list[int], k: int) -> np.ndarray:
        """Positions of the nearest cells that hold ``k`` tuples with each feature that ``x`` lacks."""
        bound = self.bounds(x)
        near = np.argsort(bound, kind="stable")
        near = near[np.isfinite(bound[near])]
        need = 0
        for j in gaps:
            if np.isnan(x[j]):
                need = max(need, int(np.searchsorted(np.cumsum(self.count[near, j]), k)) + 1)
        return near[:need]

    def rest(self, x: np.ndarray, reach: dict[int, float], gaps: list[int], k: int) -> np.ndarray:
        """Positions of the other cells that may hold a tuple within ``reach`` of a feature."""
        bound = self.bounds(x)
        open_ = np.zeros(len(bound), bool)
        for j in gaps:
            if np.isnan(x[j]):
                open_ |= (bound <= reach.get(j, np.inf)) & np.isfinite(bound) & (self.count[:, j] > 0)
        open_[self.first(x, gaps, k)] = False
        return np.flatnonzero(open_)


def _array(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def feature_sets(queries: DataFrame, width: int, indexes: int = INDEXES) -> list[tuple[int, ...]]:
    """The most frequent sets of features that queries have, and all features at the end."""
    known = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: ~F.isnan(F.get("x", j)))
    found = queries.select(known.alias("known")).where(F.size("known") > 0).groupBy("known").count().orderBy(F.desc("count"), "known").limit(indexes).collect()
    return [tuple(r.known) for r in found] + [tuple(range(width))]


def in_cells(tuples: DataFrame, queries: DataFrame, width: int, cells: int | None = None) -> tuple[DataFrame, Cells]:
    """``cell``, ``x`` and ``n`` of every tuple (``x``, ``n``) in each index, written out, and the table of cells."""
    value = lambda j: F.nanvl(F.col("x")[j], F.lit(None).cast("double"))
    rows, *spread = tuples.agg(F.count("*"), *[F.stddev_pop(value(j)) for j in range(width)]).first()
    scale = np.array([v if v and np.isfinite(v) else 1.0 for v in spread])
    sets = feature_sets(queries, width)
    gaps = F.size(F.filter("x", F.isnan))  # whole tuples first: a pivot without a feature would draw cells that are wide in it
    pivots = [r.x for r in tuples.select("x").orderBy(gaps, F.xxhash64("x"), "x").limit(int(min(cells or CELLS, max(1, rows // 4)))).collect()]
    whole = [p for p in pivots if not np.isnan(p).any()]
    shared = tuples.sparkSession.sparkContext.broadcast(np.array(whole or pivots, float).reshape(-1, width) / scale)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                x = _array(part.column(0), width)
                for i, features in enumerate(sets):
                    at = distances(x[:, features] / scale[list(features)], shared.value[:, features]).argmin(axis=1)
                    numbers = 2 * (CELLS * i + at) + np.isnan(x).any(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *part.columns], names=["cell", "x", "n"])

    dealt = cut(tuples.select("x", "n").mapInArrow(nearest, "cell int, x array<double>, n long"))
    figures = [f(value(j)) for f in (F.min, F.max, F.count) for j in range(width)]
    found = dealt.groupBy("cell").agg(F.count("*"), *figures).orderBy("cell").collect()
    table = np.array([[np.nan if v is None else v for v in r[2:]] for r in found], float).reshape(-1, 3, width)
    return dealt, Cells([r[0] for r in found], table[:, 0], table[:, 1], table[:, 2], np.array([r[1] for r in found], float), sets)


def _visits(queries: DataFrame, cells: Cells, gaps: list[int], k: int, again: bool) -> DataFrame:
    """``q``, ``x`` and ``cell`` of the visits of every query: its first ones, or (``again``, by ``reach``) the others."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            for row in range(len(batch)):
                x = np.array(batch.column(1)[row].as_py(), float)
                at = cells.rest(x, dict(batch.column(2)[row].as_py() or []), gaps, k) if again else cells.first(x, gaps, k)
                one = batch.slice(row, 1).select([0, 1]).take(pa.array(np.zeros(len(at), np.int64)))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array(cells.numbers[at], pa.int32())], names=["q", "x", "cell"])

    return queries.mapInArrow(run, "q long, x array<double>, cell int")


def _compared(visits: DataFrame, dealt: DataFrame, sizes: DataFrame, width: int, gaps: list[int], k: int) -> DataFrame:
    """``q``, ``j``, ``d``, ``x`` and ``n`` of the ``k`` nearest tuples that have feature ``j``, for each query and visited block."""
    groups = visits.groupBy("cell").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    asked = visits.join(groups, "cell").groupBy("cell", F.pmod(F.xxhash64("q"), F.col("groups")).alias("group")).agg(F.collect_list(F.struct("q", "x")).alias("asked"))
    blocks = dealt.join(sizes, "cell").groupBy("cell", F.pmod(F.xxhash64("x"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("x", "n")).alias("tuples"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, known in zip(batch.column(0), batch.column(1)):
                q, x = asked.values.field("q").to_numpy(), _array(asked.values.field("x"), width)
                y, n = _array(known.values.field("x"), width), known.values.field("n").to_numpy()
                order = ordered(y)
                y, n = y[order], n[order]
                far = distances(x, y)
                for j in gaps:
                    own = np.flatnonzero(~np.isnan(y[:, j]))
                    rows = np.flatnonzero(np.isnan(x[:, j]))
                    if not len(own) or not len(rows):
                        continue
                    d = far[np.ix_(rows, own)]
                    few = np.argsort(d, axis=1, kind="stable")[:, :k]
                    d = np.take_along_axis(d, few, axis=1)
                    there, place = np.nonzero(np.isfinite(d))
                    picked = own[few[there, place]]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(picked) + 1, width), pa.int32()), pa.array(y[picked].ravel()))
                    columns = [pa.array(q[rows[there]]), pa.array(np.full(len(picked), j), pa.int32()), pa.array(d[there, place]), lists, pa.array(n[picked])]
                    yield pa.RecordBatch.from_arrays(columns, names=["q", "j", "d", "x", "n"])

    return asked.join(blocks, "cell").select("asked", "tuples").mapInArrow(run, "q long, j int, d double, x array<double>, n long")


def taken(near: DataFrame, k: int) -> DataFrame:
    """``near`` cut to the ``k`` nearest for each query and feature, ties by tuple; ``take``: how often a tuple counts."""
    before = F.sum("n").over(Window.partitionBy("q", "j").orderBy("d", "x").rowsBetween(Window.unboundedPreceding, -1))
    return near.withColumn("take", F.least("n", F.lit(k) - F.coalesce(before, F.lit(0)))).where("take > 0")


def nearest(tuples: DataFrame, queries: DataFrame, width: int, gaps: list[int], k: int, report: dict | None = None) -> DataFrame:
    """For the incomplete tuples ``queries`` (``q``, ``x``) the ``k`` nearest of ``tuples`` (``x``, ``n`` times each) that have the features they
    lack among ``gaps``: ``q``, ``j``, ``d``, ``x``, ``n`` and ``take``. ``report`` receives the comparisons made and those of all pairs."""
    dealt, cells = in_cells(tuples, queries, width)
    spark = tuples.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(int(c), int(s)) for c, s in zip(cells.numbers, cells.size)], "cell int, size long").withColumn("blocks", F.ceil(F.col("size") / BLOCK)))
    early = cut(_visits(queries.select("q", "x"), cells, gaps, k, False))
    found = cut(taken(_compared(early, dealt, sizes.select("cell", "blocks"), width, gaps, k), k))
    reach = found.groupBy("q", "j").agg(F.when(F.sum("take") == k, F.max("d")).otherwise(F.lit(float("inf"))).alias("d"))
    reach = reach.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("j", "d"))).alias("reach"))
    late = cut(_visits(queries.join(reach, "q", "left").select("q", "x", "reach"), cells, gaps, k, True))
    if report is not None:
        made = early.unionByName(late).join(sizes, "cell").agg(F.sum("size")).first()[0] or 0
        report.update(compared=made, pairs=tuples.count() * queries.count())
    return taken(found.drop("take").unionByName(_compared(late, dealt, sizes.select("cell", "blocks"), width, gaps, k)), k)
