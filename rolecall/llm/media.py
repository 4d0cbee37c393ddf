"""Media columns: WAV payloads, short-time spectra and peak-pair fingerprints.

A payload is stored losslessly as mono 8-bit samples by the ``wave`` module and
read back by it.  The samples' short-time Fourier transform (Hann window of
``FRAME``, step ``STEP``) gives the strongest peak of each band in each frame;
a peak is paired with the peaks of the next ``REACH`` frames in its own and the
neighbouring band, and each pair (bin, bin, distance) is stored as a number
with its time, the frame of the first peak.
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

from . import words as W

FRAME = 256
STEP = 128
RATE = 8000
REACH = 3
PAD = 64
#: Band edges in bins; band k is [edge k, edge k + 1).
BANDS = np.array([1, 9, 25, 57, 129])
_BLOCK = 4096
#: Bytes of text whose media are held at once; a longer text stands alone.
HELD = 4 << 20


def padded(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (max(PAD, -(-len(text) // PAD) * PAD) - len(text))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframesraw(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """[frames, bands]: the bin of the strongest value of each band, and whether it
    is a peak, that is above its frame's mean and not weaker than in the frames beside it."""
    x = np.frombuffer(payload, np.uint8)
    frames = 1 if len(x) <= FRAME else 1 + -(-(len(x) - FRAME) // STEP)
    x = np.append(x, np.zeros((frames - 1) * STEP + FRAME - len(x), np.uint8))
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::STEP]
    bins = np.empty((frames, len(BANDS) - 1), np.int64)
    power = np.empty((frames, len(BANDS) - 1), np.float32)
    loud = np.empty((frames, len(BANDS) - 1), bool)
    for k in range(0, frames, _BLOCK):
        spectrum = np.fft.rfft((view[k : k + _BLOCK].astype(np.float32) - 128) * _WINDOW, axis=1)
        level = spectrum.real**2 + spectrum.imag**2
        mean = level[:, 1:].mean(axis=1)
        for b in range(len(BANDS) - 1):
            part = level[:, BANDS[b] : BANDS[b + 1]]
            at = part.argmax(axis=1)
            top = part[np.arange(len(part)), at]
            bins[k : k + _BLOCK, b] = at + BANDS[b]
            power[k : k + _BLOCK, b] = top
            loud[k : k + _BLOCK, b] = top > mean
    least = np.zeros((1, power.shape[1]), np.float32)
    return bins, loud & (power >= np.concatenate([least, power[:-1]])) & (power >= np.concatenate([power[1:], least]))


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame) and codes of all peak pairs, by time and code."""
    bins, peak = peaks(payload)
    times, codes = [], []
    for gap in range(1, REACH + 1):
        for near in (0, 1):
            one, two = peak[:-gap, : peak.shape[1] - near], peak[gap:, near:]
            t, b = np.nonzero(one & two)
            times.append(t)
            codes.append((bins[t, b] << 10) | (bins[t + gap, b + near] << 2) | gap)
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order], code[order]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, at = W.text_buffers(batch.column("text"))
        for i, j in W.groups(at, HELD):
            part = batch.slice(i, j - i)
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a WAV file; a null text is an empty one.
    Repeated rows and null ids get a file each; an empty table gives no files."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for media in batch.column("media"):
            raw = media.as_py()
            payload = from_wav(raw)
            time, code = fingerprint(payload)
            pairs = np.column_stack([time, code]).astype("<i4").tobytes()
            values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(raw), hashlib.sha256(raw).hexdigest(), [time, code], f"{len(time)}:{hashlib.sha256(pairs).hexdigest()}")
            for column, value in zip(out, values):
                column.append(value)
        marks = pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in out[5]]) if out[5] else [], pa.int32()) for k in (0, 1)], ["t", "code"])
        offsets = pa.array(np.append(0, np.cumsum([len(p[0]) for p in out[5]])), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string()), pa.ListArray.from_arrays(offsets, marks), pa.array(out[6], pa.string())],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "marks", "feature"],
        )


def features(media: DataFrame) -> DataFrame:
    """What each stored file holds: sizes and digests of the payload as read back and
    of the file, ``marks`` (time-coded peak pairs) and ``feature``, their count and digest.
    One row for each row of ``media``, repeated ones and null ids too; a payload of
    zeros (an empty text) has no peaks but those of its level, equal in every frame."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        _read,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, marks array<struct<t:int,code:int>>, feature string",
    )

