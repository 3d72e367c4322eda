"""Names that no user column has, and the shared folder in which lineage is cut."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where checkpoints go if a session on one machine names no shared folder.
LOCAL_FALLBACK = "file:///tmp/checkpoints"
#: Rows and bytes of one Arrow batch, whichever comes first, and slim rows that a broadcast may hold.
BATCH_ROWS, BATCH_BYTES, BROADCAST_ROWS = 400, 4 << 20, 200_000


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Such names for several columns at once."""
    return [fresh_name(df, name) for name in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a session on one machine may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = LOCAL_FALLBACK
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that a lost executor costs only its tasks."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame) -> DataFrame:
    """A slim table for one side of a join, computed once: broadcast if it has ``BROADCAST_ROWS`` rows or fewer, else left to Spark."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits, where they are larger: a batch of texts is the unit of memory in a Python worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
