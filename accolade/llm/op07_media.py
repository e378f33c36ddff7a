"""Media columns: payloads as WAV columns, spectra, and fingerprints from pairs of spectral peaks.

A payload becomes a one-channel, 8-bit WAV that the wave module writes and reads back without
loss. Its samples are cut into overlapping windows; the Fourier transform of each gives a
spectrum; the last window is filled up with the last sample, so every sample is in one. In each of a few frequency bands the strongest bin of a window is a peak if no
window within two of it is stronger there. Each peak is paired with the next peaks of its band (one that has none in reach with itself); a
pair is stored as the time of its first peak and a code of both bins and the time between them, in two arrays of equal length;
`feature` is the same as text.

Defined cases: a null text is the empty payload and is padded like one; a silent window (all
samples alike) has no peak, so a constant payload has the empty feature; repeated rows give equal
values; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from accolade.llm._shared import table

UNIT, RATE, WINDOW, HOP = 64, 8000, 256, 128
#: Bounds of the frequency bands in bins, how far a peak must stand alone, and the most partners of a peak.
BANDS, ALONE, PARTNERS, REACH = (2, 12, 32, 72, 129), 2, 2, 32
_TAPER = np.hanning(WINDOW).astype(np.float32)
_BLOCK = 4096


def pad(data: bytes) -> bytes:
    """The data with bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window and band, the strongest bin and its magnitude; blocks of windows bound the scratch memory."""
    steps = max(0, -(-(len(samples) - WINDOW) // HOP))
    samples = np.pad(samples, (0, WINDOW + steps * HOP - len(samples)), mode="edge")
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    bins, power = np.empty((len(frames), len(BANDS) - 1), np.int64), np.empty((len(frames), len(BANDS) - 1), np.float32)
    for i in range(0, len(frames), _BLOCK):
        part = frames[i : i + _BLOCK].astype(np.float32)
        spectrum = np.fft.rfft((part - part.mean(1, keepdims=True)) * _TAPER, axis=1)
        size = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        for b in range(len(BANDS) - 1):
            band = size[:, BANDS[b] : BANDS[b + 1]]
            best = band.argmax(1)
            bins[i : i + len(part), b] = best + BANDS[b]
            power[i : i + len(part), b] = band[np.arange(len(part)), best]
    return bins, power


def peak_pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time and code of each pair, by time, then code."""
    bins, power = band_peaks(samples)
    padded = np.pad(power, ((ALONE, ALONE), (0, 0)))
    around = np.max([padded[d : d + len(power)] for d in range(2 * ALONE + 1) if d != ALONE], axis=0)
    is_peak = (power > 1.0) & (power >= around)
    times, codes = [], []
    for b in range(bins.shape[1]):
        at = np.flatnonzero(is_peak[:, b])
        f = bins[at, b]
        # A peak with none behind it in reach is stored alone, as a pair with itself.
        alone = np.append(np.diff(at) >= REACH, True)[: len(at)]
        times.append(at[alone])
        codes.append((f[alone] * 256 + f[alone]) * REACH)
        for k in range(1, PARTNERS + 1):
            gap = at[k:] - at[:-k]
            near = gap < REACH
            times.append(at[:-k][near])
            codes.append((f[:-k][near] * 256 + f[k:][near]) * REACH + gap[near])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def describe(text: str | None) -> tuple:
    data = (text or "").encode()
    media = to_wav(pad(data))
    payload = from_wav(media)
    times, codes = peak_pairs(np.frombuffer(payload, np.uint8))
    feature = ",".join([f"{t:x}:{c:x}" for t, c in zip(times.tolist(), codes.tolist(), strict=True)])
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, times, codes


_FIELDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "times": pa.list_(pa.int32()), "codes": pa.list_(pa.int32())}


def _describer(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            rows = [describe(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(_FIELDS.values())]], ["doc_id", *_FIELDS])


def media_features(docs: DataFrame) -> DataFrame:
    """The query's columns for every row of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    fields = ", ".join(f"{k} {names[t]}" for k, t in _FIELDS.items())
    return docs.select("doc_id", "text").mapInArrow(_describer, f"doc_id {kind}, {fields}")


def to_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """The frame with a binary WAV column of its padded text."""

    def run(batches):
        for batch in batches:
            media = pa.array([to_wav(pad((t or "").encode())) for t in batch.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, media], [*batch.schema.names, out])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
