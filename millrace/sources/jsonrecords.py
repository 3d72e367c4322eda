"""Large JSON files read by many tasks: an array of records, one record, or records one after the other.

A file is cut at every closing brace, which Spark's text source splits by bytes. What a cut means depends on what came before: whether
it lies inside a string, and how deep. So each byte range is first summarised by a transition function: for a start outside and
inside a string, where it ends and by how much the depth changes. Composed in order (a row for each range), they give the state
at every range's start; then each range knows where its records end, and only the parts of records that reach over its ends are put
together, at most two a range.

Defined cases: white space and line breaks may stand anywhere between values; braces, brackets and escaped quotes inside strings are no
structure; an empty file and an empty array give no rows; very long records are held whole by one task; a byte order mark is skipped.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.storage import cut, shared_dir, small_batches

_MARKS = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
_STEPS = {"{": 1, "[": 1, "}": -1, "]": -1}
#: What may stand before a record.
_BEFORE = "\ufeff[, \t\r\n"


def transition(piece: str) -> tuple[bool, int, int]:
    """Of a piece and the brace after it: whether it ends on the other side of a string's edge than it began, and the change of depth if it
    began outside, or inside, a string."""
    flipped, outside, inside = False, 0, 0
    for mark in _MARKS.findall(piece):
        if mark == '"':
            flipped = not flipped
        elif mark in _STEPS:
            if flipped:
                inside += _STEPS[mark]
            else:
                outside += _STEPS[mark]
    return (flipped, outside, inside - 1) if flipped else (flipped, outside - 1, inside)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each byte range of a task."""
    ranges: dict[tuple[str, int], list] = {}
    for batch in batches:
        for piece, file, start in zip(*(c.to_pylist() for c in batch.columns)):
            state = ranges.setdefault((file, start), ["", False, 0, 0])
            state[0] = state[0] or piece.strip("\ufeff \t\r\n")[:1]
            flips, outside, inside = transition(piece)
            state[2], state[3] = (state[2] + inside, state[3] + outside) if state[1] else (state[2] + outside, state[3] + inside)
            state[1] ^= flips
    rows = [(f, s, *v) for (f, s), v in ranges.items()]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["file", "start", "first", "flips", "outside", "inside"])


def composed(ranges: list[tuple[str, int, str, bool, int, int]]) -> list[tuple[str, int, bool, int, int]]:
    """``file``, ``start``, and the state there: inside a string or not, the depth, and the depth at which records of the file end."""
    out, file, base, inside, depth = [], None, 0, False, 0
    for name, start, first, flips, outside_step, inside_step in sorted(ranges):
        if name != file:
            file, base, inside, depth = name, int(first == "["), False, 0
        out.append((name, start, inside, depth, base))
        depth += inside_step if inside else outside_step
        inside ^= flips
    return out


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and parts of records that reach over the ends of a range (``n`` not null)."""
    at, inside, depth, held, seen = None, False, 0, [], 0
    rows: list[tuple] = []

    def left() -> None:
        if at and held:
            rows.append((at[0], at[1], seen, False, "".join(held)))

    for batch in batches:
        for piece, file, start, begins_inside, begins_depth, base in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != at:
                left()
                at, inside, depth, held, seen = (file, start), begins_inside, begins_depth, [], 0
            flips, outside_step, inside_step = transition(piece)
            depth += inside_step if inside else outside_step
            inside ^= flips
            held.append(piece + "}")
            if not inside and depth == base:
                rows.append((file, start, seen if start and not seen else None, True, "".join(held)))
                held, seen = [], seen + 1
        yield _batch(rows)
        rows = []
    left()
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["file", "start", "n", "closes", "value"])


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the text of every record of the files at ``path``, in one line."""
    small_batches(spark)
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    found = pieces.mapInArrow(_summaries, "file string, start long, first string, flips boolean, outside long, inside long").collect()  # a row a range
    states = spark.createDataFrame(composed([tuple(r) for r in found]), "file string, start long, inside boolean, depth long, base int")
    known = pieces.join(F.broadcast(states), ["file", "start"]).select("value", "file", "start", "inside", "depth", "base")  # a row a range; the order of pieces stays
    parts = cut(known.mapInArrow(_records, "file string, start long, n long, closes boolean, value string"))
    whole = parts.where("n IS NULL").select("value")
    earlier = Window.partitionBy("file").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    cut_up = parts.where("n IS NOT NULL").withColumn("record", F.coalesce(F.sum(F.col("closes").cast("int")).over(earlier), F.lit(0)))
    joined = cut_up.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "n", "value"))).alias("parts"), F.max("closes").alias("closes"))
    joined = joined.where("closes").select(F.array_join("parts.value", "").alias("value"))
    return whole.unionByName(joined).select(F.translate(F.ltrim(F.col("value"), F.lit(_BEFORE)), "\r\n", "  ").alias("value"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The records at ``path`` as a table; without ``schema`` it is inferred from all of them."""
    lines = f"{shared_dir(spark)}/json-records-{uuid.uuid4().hex}"
    json_records(spark, path).write.text(lines)
    return (spark.read.schema(schema) if schema else spark.read).json(lines)
