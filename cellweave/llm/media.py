"""Media columns: WAV bytes, short-time Fourier transforms and peak-pair fingerprints.

A media column is binary WAV.  The wave module writes and reads it; a Hann-windowed
short-time Fourier transform gives spectra, local maxima of a spectrum are its
peaks, and each peak is paired with the peaks of the next frames.  A pair is stored
with the frame of its anchor: a time-coded array of (time, code).

Media without such a pair (all that one frame holds, 512 samples or fewer) is read
again with half a frame of silence on each side, so that its ends lie in the middle
of frames, and peaks of one frame are paired too.

Defined cases: null media has no samples and an empty fingerprint, as has media of
one value all through (silence, or one character again and again), which has no peaks;
media of any length is transformed whole, in blocks of
FRAMES; equal bytes give equal features.
"""

from __future__ import annotations

import io
import wave
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import documents, map_texts, slices, text_of

RATE = 8000
#: Samples of a frame and between frames; peaks of a frame; frames ahead that an anchor is paired with; frames of a block.
FRAME, HOP, PEAKS, AHEAD, FRAMES = 512, 256, 3, 2, 4096
#: Bytes of text that a payload is filled up to a multiple of.
UNIT = 64

_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono WAV whose samples are the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The sample bytes of a WAV of any width or number of channels."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectra(samples: np.ndarray) -> np.ndarray:
    """Magnitudes by frame: a last frame that isn't full is filled with silence."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(samples)] = samples
    return np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP] * _WINDOW, axis=1)).astype(np.float32)


def peaks(magnitudes: np.ndarray) -> np.ndarray:
    """Bins of the PEAKS highest local maxima of each frame, ascending; 0 where there are fewer."""
    m = magnitudes
    top = (m[:, 1:-1] > m[:, :-2]) & (m[:, 1:-1] >= m[:, 2:]) & (m[:, 1:-1] > 1.0)
    level = np.where(top, np.round(m[:, 1:-1], 2), 0)
    best = np.argpartition(-level, PEAKS - 1, axis=1)[:, :PEAKS]
    held = np.take_along_axis(level, best, 1) > 0
    return np.sort(np.where(held, best + 1, 0), axis=1)


def frame_peaks(samples: np.ndarray) -> np.ndarray:
    """Peaks of all frames, a block of FRAMES at a time."""
    found = []
    for at in range(0, max(1, len(samples)), FRAMES * HOP):
        block = samples[at : at + (FRAMES - 1) * HOP + FRAME]
        p = peaks(spectra(block))
        found.append(p[:FRAMES] if at + FRAMES * HOP < len(samples) else p)
    return np.concatenate(found)


def pairs(p: np.ndarray, gaps: range) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of peaks that are so many frames apart; in one frame (gap 0) a peak with itself and those above it."""
    n, times, codes = len(p), [], []
    for gap in gaps:
        if n > gap:
            a, b = p[: n - gap, :, None], p[gap:, None, :]
            both = (a > 0) & (b > 0) & ((a <= b) | (gap > 0))
            code = (a << 18) | (b << 8) | gap
            t = np.broadcast_to(np.arange(n - gap)[:, None, None], code.shape)
            times.append(t[both])
            codes.append(code[both])
    if not times:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pairs: frames of anchors and codes (bin, other bin, frames between)."""
    times, codes = pairs(frame_peaks(samples), range(1, AHEAD + 1))
    if not len(codes):
        times, codes = pairs(frame_peaks(np.pad(samples, FRAME // 2)), range(AHEAD + 1))
    return times, codes


def samples_of(frames: bytes) -> np.ndarray:
    return np.frombuffer(frames, np.uint8).astype(np.float32) - 128


def fingerprints(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df plus times and codes (arrays of equal length) of its WAV column, which replace columns of those names.

    Media are read a few megabytes at a time; a longer one is a step by itself.
    """
    keep = [c for c in df.columns if c.lower() not in ("times", "codes")]
    schema = T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL("times array<bigint>, codes array<bigint>").fields])

    def run(batches):
        for batch in batches:
            for part in slices(batch, media_col):
                made = [fingerprint(samples_of(from_wav(m))) if m is not None else (np.empty(0, np.int64),) * 2 for m in part.column(media_col).to_pylist()]
                lists = [pa.array([x[k].tolist() for x in made], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def text_media(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """df plus the WAV that stores its text, which replaces a column of that name."""
    return map_texts(df.withColumn("__text", text_of(text_col)), lambda texts: {out: pa.array([to_wav(payload_of(t)[1]) for t in texts], pa.binary())}, f"`{out}` binary")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fn(texts):
        rows = []
        for t in texts:
            n, payload = payload_of(t)
            media = to_wav(payload)
            back = from_wav(media)
            times, codes = fingerprint(samples_of(back))
            rows.append((n, len(back), sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), sha256(media).hexdigest(), " ".join(map("%d:%x".__mod__, zip(times.tolist(), codes.tolist(), strict=True)))))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return {name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(NAMES, kinds, strict=True))}

    d = documents(spark, sf_dir).select("doc_id", text_of().alias("__text"))
    return map_texts(d, fn, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
