"""Helpers shared by the corpus operators: shared storage, batch sizes, split rules and size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, whichever comes first: a batch is the unit of memory in a worker.
BATCH_ROWS, BATCH_BYTES = 400, 4 << 20
#: Slim rows that one file of an intermediate table may hold, and the most files a narrowed write makes.
FILE_ROWS = 500_000
MAX_COALESCED = 10_000
#: Slim rows (a key or two) that a broadcast may hold: some 100 MB when hashed.
BROADCAST_ROWS = 1_000_000
#: Where tables go if a session on one machine names no shared folder (tests only).
LOCAL_FALLBACK = "file:///tmp/checkpoints"
T = TypeVar("T")
_resident: dict[object, object] = {}


def resident(key: object, make: Callable[[], T]) -> T:
    """The one large object (scorer, vocabulary) that this Python worker holds for ``key``.

    Workers are used again by later operators: asking for another key lets go of the earlier object first, so that what
    the stages of a pipeline need does not pile up.
    """
    if key not in _resident:
        _resident.clear()
        release()
        _resident[key] = make()
    return _resident[key]  # type: ignore[return-value]


def release() -> None:
    """Give memory that nothing uses any more back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of most Linux systems has it
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a session on one machine may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = LOCAL_FALLBACK
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, and its lineage is cut.

    A lost executor costs only the tasks it ran; what is written stays readable for all others. ``rows``: an upper bound
    of its rows, where one is known; small tables are then written by few tasks.
    """
    path = new_path(df.sparkSession, name)
    out = df if rows is None else df.coalesce(min(1 + rows // FILE_ROWS, MAX_COALESCED))
    out.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with a key for each row (a struct of two longs), and that column's name: rows stay apart whatever their ids are.

    The rows of a table read from files are known by file and place, so nothing is copied; what comes from elsewhere is written
    out with numbers under ``name`` first, since it may not come in the same order twice.
    """
    key = fresh_name(df, "row_key")
    try:
        keyed = df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias(key))
        keyed.schema  # noqa: B018  analysed here: only a table read from files has the metadata
    except AnalysisException:
        keyed = materialise(df.withColumn(key, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place"))), name)
    return keyed, key


def small_side(df: DataFrame) -> DataFrame:
    """A slim stored table for one side of a join: marked for broadcast if it is counted to have ``BROADCAST_ROWS`` rows or fewer, else
    left to Spark."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lower the session's Arrow batch limits, where they are larger, so that long texts fit a Python worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the split rule of labelled rows. Null ids give -1 (never held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod)), F.lit(-1)).cast("int")


def row_share(rows: int, bound: int, *cols: str) -> Column:
    """True for about ``bound`` of ``rows`` rows of a materialised table, drawn by row: equal rows are drawn one by one."""
    parts = 1_000_000_000
    keep = parts if rows <= bound else max(1, int(parts * bound / rows))
    return F.pmod(F.xxhash64(F.monotonically_increasing_id(), *cols), F.lit(parts)) < keep
