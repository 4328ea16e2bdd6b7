"""Media columns: texts' bytes kept as 8-bit audio, with log-mel tensors and time spans.

``store`` pads a payload to whole blocks and writes it as a PCM WAV file, one byte a sample.
``features`` reads the stored bytes back, resamples them with a polyphase filter, takes
overlapped log-mel filterbanks, cuts the signal into active spans by energy with hysteresis, and
keeps the filterbanks as fixed-shape tensors, each with its time span, in Arrow's IPC format.

Edge cases: a null or empty text is one block of blanks; equal texts give equal bytes, since
every record is computed alone; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.common import text_bytes, text_chunks

#: Payload unit in bytes, and what it is filled with.
BLOCK, FILL = 192, b" "


@dataclass(frozen=True)
class Settings:
    rate: int = 12_000  # of the stored samples
    up: int = 2  # resampled to rate * up / down
    down: int = 3
    taps: int = 12  # of the filter, a phase
    window: int = 200  # samples a frame, then between frames
    hop: int = 80
    fft: int = 256
    mels: int = 24
    patch: int = 32  # frames a tensor
    open_db: float = 1.0  # a span opens so far above the median energy and closes below the other
    close_db: float = -1.0

    @property
    def out_rate(self) -> int:
        return self.rate * self.up // self.down


def store(payload: bytes, s: Settings) -> bytes:
    """A WAV file of unsigned 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(s.rate)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def padded(text: bytes) -> bytes:
    return text + FILL * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


@lru_cache(maxsize=4)
def _phases(s: Settings) -> list[np.ndarray]:
    """Windowed-sinc low-pass at the lower of the two band limits, one filter a phase."""
    n = s.taps * s.up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(s.up, s.down)
    h = (cut * np.sinc(cut * t) * np.hamming(n)).astype(np.float32)
    h *= s.up / h.sum()
    return [h[p :: s.up] for p in range(s.up)]


def resample(x: np.ndarray, s: Settings) -> np.ndarray:
    """Output m is the sum over k of phase[(m * down) % up][k] * x[(m * down) // up - k]."""
    m = (len(x) * s.up) // s.down
    ahead = np.concatenate([np.zeros(s.taps - 1, np.float32), x, np.zeros(s.down, np.float32)])
    out = np.empty(m, dtype=np.float32)
    for r in range(s.up):  # outputs r, r + up, ... share a phase and step by `down` inputs
        n = len(range(r, m, s.up))
        start, phase = (r * s.down) // s.up, _phases(s)[(r * s.down) % s.up]
        acc = np.zeros(n, dtype=np.float32)
        for k, h in enumerate(phase):
            lo = start + s.taps - 1 - k
            acc += h * ahead[lo : lo + n * s.down : s.down][:n]
        out[r :: s.up] = acc
    return out


@lru_cache(maxsize=4)
def _bank(s: Settings) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(s.out_rate / 2), s.mels + 2) / 2595) - 1)
    f = np.linspace(0, s.out_rate / 2, s.fft // 2 + 1)
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Log filterbank and energy in dB of each frame; the last frame is filled up."""
    n = 1 + max(0, -(-(len(x) - s.window) // s.hop))
    x = np.concatenate([x, np.zeros(s.window + (n - 1) * s.hop - len(x), np.float32)]) if len(x) < s.window + (n - 1) * s.hop else x
    frames = np.lib.stride_tricks.sliding_window_view(x, s.window)[:: s.hop][:n]
    mels, energy = np.empty((n, s.mels), np.float32), np.empty(n, np.float32)
    taper = np.hanning(s.window).astype(np.float32)
    for lo in range(0, n, 1024):  # bounded memory for long records
        part = frames[lo : lo + 1024] * taper
        power = np.abs(np.fft.rfft(part, s.fft, axis=1)).astype(np.float32) ** 2
        mels[lo : lo + 1024] = np.log(power @ _bank(s) + np.float32(1e-6))
        energy[lo : lo + 1024] = 10 * np.log10(power.sum(axis=1) + np.float32(1e-9))
    return mels, energy


def spans(energy: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """Frames [from, to) of each active span: opened by one threshold, closed by the lower one."""
    level = energy - np.median(energy)
    state = np.where(level >= s.open_db, 1, np.where(level < s.close_db, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    active = np.where(last >= 0, state[np.maximum(last, 0)], 0)
    edge = np.diff(np.r_[0, active, 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def tensors(mels: np.ndarray, s: Settings) -> bytes:
    """An Arrow stream of ``start_ms, end_ms, log_mel`` with a tensor of patch x mels a row."""
    n = -(-len(mels) // s.patch)
    full = np.zeros((n * s.patch, s.mels), np.float32)
    full[: len(mels)] = mels
    kind = pa.fixed_shape_tensor(pa.float32(), (s.patch, s.mels))
    values = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), s.patch * s.mels))
    starts = np.arange(n) * s.patch * s.hop * 1000 // s.out_rate
    ends = (np.minimum(np.arange(1, n + 1) * s.patch, len(mels)) - 1) * s.hop + s.window
    batch = pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(ends * 1000 // s.out_rate, pa.int64()), values], ["start_ms", "end_ms", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def describe(mels: np.ndarray, active: list[tuple[int, int]], s: Settings) -> str:
    means = ",".join(f"{v:.2f}" for v in mels.mean(axis=0, dtype=np.float64)[:: max(1, s.mels // 6)])
    voiced = sum(b - a for a, b in active) * s.hop * 1000 // s.out_rate
    return f"frames={len(mels)};tensor={-(-len(mels) // s.patch)}x{s.patch}x{s.mels};spans={len(active)};active_ms={voiced};mel={means}"


OUTPUT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, tensors binary, spans array<struct<start_ms:int,end_ms:int>>, feature string"


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``id_col`` with the stored media, its tensors and spans, and digests of the payload read back."""
    s = settings
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL(OUTPUT).fields])

    def record(text: bytes) -> tuple:
        media = store(padded(text), s)
        payload = load(media)
        x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
        mels, energy = log_mel(resample(x, s), s)
        active = spans(energy, s)
        ms = [{"start_ms": a * s.hop * 1000 // s.out_rate, "end_ms": ((b - 1) * s.hop + s.window) * 1000 // s.out_rate} for a, b in active]
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), media, tensors(mels, s), ms, describe(mels, active, s)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("start_ms", pa.int32()), ("end_ms", pa.int32())])), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_chunks(batch, "t"):
                columns = zip(*map(record, text_bytes(batch, lo, hi, "t")), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("i").slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.fieldNames())

    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, schema)


def media_digest(media: DataFrame) -> DataFrame:
    return media.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
