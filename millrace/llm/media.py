"""Media columns: bytes kept as WAV samples, short-time Fourier transforms, and fingerprints of spectral-peak pairs.

``store`` turns a text's bytes (padded to whole blocks) into a WAV file of unsigned 8-bit samples, written by the wave
module; ``read`` opens the stored bytes again with the wave module and returns the samples and the fingerprint.

A fingerprint is an array of longs, each ``time << 20 | first bin << 13 | second bin << 6 | time difference``: a pair of
spectral peaks and the frame at which it begins, in order of time. Long recordings are transformed in blocks of frames, so
memory does not grow with the spectrogram.

Defined cases: null text is empty text; an empty text is one block of zeros and has no peaks; equal texts have equal
values; a media value that is null or no WAV file gives nulls; very long texts are one file each, transformed in blocks; repeated
rows are stored each; an empty table gives no rows. Columns that a result makes (``n_bytes`` and the media column, ``payload`` and
``landmarks``) take the place of those of the same name; other columns may have any name.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh_name, small_batches

BLOCK = 64
RATE = 8000
FRAME, HOP = 256, 128
#: Peaks kept in a frame, later peaks paired with each, and the most frames between the two.
PEAKS, FAN, REACH = 2, 2, 63
FRAMES_AT_ONCE = 4096
_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def pad(raw: bytes) -> bytes:
    """``raw`` with zeros up to a positive multiple of ``BLOCK`` bytes."""
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectrogram(samples: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of magnitudes (frames x bins) with the number of their first frame; silence fills the last frame."""
    x = np.frombuffer(samples, np.uint8)
    frames = 1 + -(-max(0, len(x) - FRAME) // HOP)
    for a in range(0, frames, FRAMES_AT_ONCE):
        b = min(frames, a + FRAMES_AT_ONCE)
        part = x[a * HOP : (b - 1) * HOP + FRAME].astype(np.float32) - 128
        missing = (b - 1 - a) * HOP + FRAME - len(part)
        if missing:
            part = np.concatenate([part, np.zeros(missing, np.float32)])
        windows = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        yield a, np.abs(np.fft.rfft(windows * _HANN, axis=1))[:, : FRAME // 2]


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of the ``PEAKS`` strongest local maxima of every frame, in order of time, then frequency."""
    times, bins = [], []
    for first, power in spectrogram(samples):
        inner = power[:, 1:-1]
        high = (inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1e-3)
        ranked = np.where(high, inner, 0)
        best = np.argpartition(-ranked, PEAKS - 1, axis=1)[:, :PEAKS]
        best.sort(axis=1)
        real = np.take_along_axis(ranked, best, axis=1) > 0
        t, k = np.nonzero(real)
        times.append(t + first)
        bins.append(best[t, k] + 1)
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs: each peak with those of the ``FAN + PEAKS - 1`` following ones that lie in later frames."""
    times, bins = peaks(samples)
    codes = []
    n = len(times)
    for gap in range(1, FAN + PEAKS):
        if gap >= n:
            break
        dt = times[gap:] - times[:-gap]
        near = np.flatnonzero((dt >= 1) & (dt <= REACH))
        codes.append((times[near].astype(np.int64) << 20) | (bins[near].astype(np.int64) << 13) | (bins[near + gap].astype(np.int64) << 6) | dt[near])
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def store(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), media_col: str = "media") -> DataFrame:
    """Columns ``keep``, ``n_bytes`` and ``media_col`` (the WAV file's bytes)."""
    small_batches(df.sparkSession)
    keep = tuple(c for c in keep if c.lower() not in ("n_bytes", media_col.lower()))
    names = [*keep, "n_bytes", media_col]
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    src = df.select(*keep, F.octet_length(raw).cast("long").alias("n_bytes"), raw.alias(fresh_name(df, "raw")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [to_wav(pad(x.as_py())) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(media, pa.binary())], names=names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{kept}, `{media_col}` binary")


def read(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with ``payload`` (the samples read back) and ``landmarks`` (the fingerprint) of the stored files."""
    small_batches(df.sparkSession)
    df = df.select(*[c for c in df.columns if c.lower() not in ("payload", "landmarks")])
    names = [*df.columns, "payload", "landmarks"]
    at = df.columns.index(media_col)

    def opened(media: bytes | None) -> tuple[bytes | None, np.ndarray | None]:
        if media is None:
            return None, None
        try:
            samples = from_wav(media)
        except (wave.Error, EOFError):
            return None, None
        return samples, fingerprint(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [opened(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([p for p, _ in pairs], pa.binary()), pa.array([f for _, f in pairs], pa.list_(pa.int64()))], names=names
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kept}, payload binary, landmarks array<long>")


def feature(landmarks: str = "landmarks") -> Column:
    """A short text for a fingerprint: the number of pairs and the SHA-256 of the codes in order."""
    return F.concat_ws(":", F.size(landmarks).cast("string"), F.sha2(F.array_join(landmarks, ",").cast("binary"), 256))


def op1_media(spark, sf_dir: str) -> DataFrame:
    stored = store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = read(stored)
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature().alias("feature"),
        "landmarks",
    )
