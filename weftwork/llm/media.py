"""Media columns: 8-bit WAV audio, read by the wave module, with spectral-peak pair fingerprints.

The short-time Fourier transform uses frames of 256 samples every 128 under a Hann window. In each of six bands of
frequencies the strongest bin of a frame is a peak if it is also the strongest among the neighbouring frames. Each peak is
paired with the next ones within a target zone; a pair is stored as (time, code) with code = f1 << 18 | f2 << 8 | dt. All
steps work on one medium at a time, so equal media have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, HOP, RATE, ALIGN = 256, 128, 8000, 64
BANDS = ((1, 4), (4, 8), (8, 16), (16, 32), (32, 64), (64, 129))
FAN, ZONE = 3, 32
#: Frames that are transformed at a time.
BLOCK = 1024
_hann = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def pad(payload: bytes, align: int = ALIGN) -> bytes:
    """Zero bytes appended up to a positive multiple of `align`."""
    return payload + b"\0" * (max(align, -(-len(payload) // align) * align) - len(payload))


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file with 8-bit samples."""
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(rate)
            w.writeframes(samples)
        return out.getvalue()


def read_wav(data: bytes) -> bytes:
    """The samples of a mono 8-bit WAV file."""
    with wave.open(io.BytesIO(data), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not mono 8-bit audio")
        return w.readframes(w.getnframes())


def spectrum(samples: np.ndarray) -> np.ndarray:
    """Power of each frame and bin; a last frame is filled with silence, so that every sample is in some frame."""
    x = samples.astype(np.float32) - 128
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + FRAME - len(x), np.float32)])
    cut = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    return np.abs(np.fft.rfft(cut * _hann, axis=1)) ** 2


def band_tops(samples: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(power, bin) of the strongest bin of each band and frame. Frames are transformed a block at a time, so that a long
    medium needs little more than its own bytes."""
    frames = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    tops, bins = np.zeros((frames, len(BANDS)), np.float32), np.zeros((frames, len(BANDS)), np.int32)
    for at in range(0, frames, block):
        stop = min(frames, at + block)
        power = spectrum(samples[at * HOP : (stop - 1) * HOP + FRAME])
        for k, (lo, hi) in enumerate(BANDS):
            best = power[:, lo:hi].argmax(axis=1)
            tops[at:stop, k] = power[np.arange(stop - at), best + lo]
            bins[at:stop, k] = best + lo
    return tops, bins


def peaks(tops: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the peaks, by frame and then bin; silence has none."""
    times, found = [], []
    for k in range(len(BANDS)):
        around = np.concatenate([[-1.0], tops[:, k], [-1.0]]).astype(np.float32)
        t = np.flatnonzero((tops[:, k] > 1e-3) & (tops[:, k] >= around[:-2]) & (tops[:, k] > around[2:]))
        times.append(t)
        found.append(bins[t, k])
    t, f = np.concatenate(times), np.concatenate(found).astype(np.int64)
    order = np.lexsort((f, t))
    return t[order], f[order]


def pair_codes(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time and code of each peak with the FAN peaks that follow it in the list, those in the same frame or beyond ZONE left out."""
    times, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, FAN + 1):
        if len(t) > step:
            dt = t[step:] - t[:-step]
            ok = (dt > 0) & (dt <= ZONE)
            times.append(t[:-step][ok])
            codes.append((f[:-step] << 18 | f[step:] << 8 | dt)[ok])
    t2, c2 = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c2, t2))
    return t2[order], c2[order]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded fingerprints of a medium: parallel arrays of frame numbers and pair codes."""
    return pair_codes(*peaks(*band_tops(np.frombuffer(samples, np.uint8))))


_FULL = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))])
_DIGEST = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_peak_pairs", pa.int64())])


def _media(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), write_wav(pad(raw))


def _full(text: str | None) -> tuple:
    n, media = _media(text)
    times, codes = fingerprint(read_wav(media))
    return n, media, times.tolist(), codes.tolist()


def _digest(text: str | None) -> tuple:
    n, media = _media(text)
    payload = read_wav(media)
    times, codes = fingerprint(payload)
    coded = times.astype("<u4").tobytes() + codes.astype("<u4").tobytes()
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(codes)}:{hashlib.sha256(coded).hexdigest()[:32]}", len(codes)


def _run(make, schema: pa.Schema, most: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                out = [(k, *make(v.as_py())) for k, v in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media, times, codes): each text's padded UTF-8 bytes as a WAV file with its fingerprint arrays.

    Null texts count as empty; an empty text is 64 zero bytes. One row for each row of `docs`, repeated rows and null ids
    included; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run(_full, _FULL), "id long, n_bytes long, media binary, times array<int>, codes array<int>").withColumnRenamed("id", id_col)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sizes, digests and a feature string of each row's medium, without keeping the media; rows as for `to_media`.

    An empty table gives no rows; texts of any length are stored and read back whole, and transformed in blocks of frames.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spec = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_peak_pairs long"
    return rows.mapInArrow(_run(_digest, _DIGEST), spec).withColumnRenamed("id", id_col)
