"""Audio columns: texts as 8-bit audio, and features of audio.

``store`` writes each payload losslessly as the 8-bit samples of a WAV file, in a binary column of Parquet files, and reads these files; ``decode`` reads such
a column's bytes. ``extract`` computes features of the samples read: polyphase resampling by 3/4, log-mel energies of overlapping frames (zeros fill the last one), cut
into patches of a fixed shape, and segments of
energy found with hysteresis (a segment starts above the upper level and ends below the lower). It keeps the patches
as an Arrow IPC stream, whose column ``patch`` has the fixed-shape tensor type and whose columns start_ms and end_ms are
the patch's time span. A document is handled alone, so equal texts have equal values, and memory holds a few megabytes of
texts at a time, or one document.

Defined cases: a null text is empty; an empty text is 576 bytes of 255; null and repeated doc_ids are rows like others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relspark.llm.common import spread
from relspark.llm.units import byte_chunks

RATE, UP, DOWN = 8000, 3, 4
TAPS = 8
FRAME, HOP, FFT, MELS, PATCH = 150, 60, 256, 20, 64
BLOCK, FILL = 576, 255
#: Hysteresis levels in dB above the median frame.
UPPER, LOWER = 1.5, 0.0
#: Bytes of texts or samples handled at a time; it bounds memory, not results.
CHUNK_BYTES = 1_000_000
STORED = "doc_id long, n_bytes long, media binary"
SCHEMA = f"{STORED}, tensor binary, segments array<struct<start_ms: int, end_ms: int>>"


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8")
    return data + bytes([FILL]) * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data)), len(data)


def encode(payload: bytes, rate: int = RATE) -> bytes:
    pad = b"\0" * (len(payload) % 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload) + len(pad), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + pad


def decode(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of a WAV file with one channel of 8 bits."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only PCM with one channel of 8 bits")
        if kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _prototype() -> np.ndarray:
    """Low-pass filter for the rate RATE * UP: a Hann-windowed sinc, in UP rows of TAPS (one row a phase)."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * (0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n))
    return (h * UP / h.sum()).reshape(TAPS, UP).T.astype(np.float32)


def _mel_bank(rate: float) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


FILTER = _prototype()
BANK = _mel_bank(RATE * UP / DOWN)
WINDOW = np.hanning(FRAME).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP/DOWN of its rate. Each output phase has its own row of taps; no zeros are inserted or multiplied."""
    n_out = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)])
    y = np.zeros(n_out, np.float32)
    for first in range(min(UP, n_out)):
        n = len(range(first, n_out, UP))
        start, phase = divmod(first * DOWN, UP)
        acc = np.zeros(n, np.float32)
        for t in range(TAPS):
            at = start + TAPS - 1 - t
            acc += FILTER[phase, t] * padded[at : at + (n - 1) * DOWN + 1 : DOWN]
        y[first::UP] = acc
    return y


def log_mel(y: np.ndarray) -> np.ndarray:
    """Frames x MELS of log10 energies; frames overlap by FRAME - HOP samples; zeros fill the last one, so each sample is in a frame."""
    hops = max(0, -(-(len(y) - FRAME) // HOP))
    y = np.concatenate([y, np.zeros(hops * HOP + FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    for i in range(0, len(frames), 2048):
        spectrum = np.fft.rfft(frames[i : i + 2048] * WINDOW, FFT)
        out[i : i + 2048] = np.log10((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ BANK + 1e-6)
    return out


def segments_of(mel: np.ndarray, upper: float = UPPER, lower: float = LOWER) -> list[tuple[int, int]]:
    """(first frame, end) of stretches that rise above the upper level and last until they fall below the lower."""
    energy = 10 * np.log10((10.0 ** mel.astype(np.float64)).sum(axis=1))
    energy = np.round(energy - np.median(energy), 2)
    event = np.where(energy > upper, 1, np.where(energy < lower, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = (last >= 0) & (event[last] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def patches_of(mel: np.ndarray) -> np.ndarray:
    n = -(-len(mel) // PATCH)
    out = np.zeros((n * PATCH, MELS), np.float32)
    out[: len(mel)] = mel
    return out.reshape(n, PATCH, MELS)


def _ms(frame: int) -> int:
    return frame * HOP * 1000 * DOWN // (RATE * UP)


def to_ipc(patches: np.ndarray, frames: int) -> bytes:
    """Arrow stream: patch (fixed-shape tensor), start_ms, end_ms."""
    starts = [_ms(i * PATCH) for i in range(len(patches))]
    ends = [_ms(min((i + 1) * PATCH, frames)) for i in range(len(patches))]
    batch = pa.record_batch([pa.FixedShapeTensorArray.from_numpy_ndarray(patches), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["patch", "start_ms", "end_ms"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def from_ipc(data: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return batch.column("patch").to_numpy_ndarray(), list(zip(batch.column("start_ms").to_pylist(), batch.column("end_ms").to_pylist(), strict=True))


def features(media: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The tensor stream and the segments (ms) of stored audio."""
    _, samples = decode(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x))
    return to_ipc(patches_of(mel), len(mel)), [(_ms(a), _ms(b)) for a, b in segments_of(mel)]


def _encode(batches):
    for batch in batches:
        for i, j in byte_chunks(batch.column("text"), CHUNK_BYTES):
            payloads = [payload_of(t) for t in batch.column("text")[i:j].to_pylist()]
            columns = [batch.column("doc_id")[i:j], pa.array([n for _, n in payloads], pa.int64()), pa.array([encode(p) for p, _ in payloads], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, path: str) -> DataFrame:
    """Write doc_id, n_bytes (of the text) and media (WAV) under ``path``, and return them as read from there."""
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows.mapInArrow(_encode, STORED).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(STORED).parquet(path)


def _extract(batches):
    for batch in batches:
        for i, j in byte_chunks(batch.column("media"), CHUNK_BYTES):
            found = [features(m) for m in batch.column("media")[i:j].to_pylist()]
            spans = pa.array([[{"start_ms": a, "end_ms": b} for a, b in own] for _, own in found], pa.list_(pa.struct([("start_ms", pa.int32()), ("end_ms", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array([t for t, _ in found], pa.binary()), spans], names=["doc_id", "n_bytes", "media", "tensor", "segments"])


def extract(stored: DataFrame) -> DataFrame:
    """``stored`` with tensor (Arrow stream of fixed-shape patches with spans) and segments, both of the stored samples."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_extract, SCHEMA)


def feature_text(tensor: bytes, segments: list[dict]) -> str:
    """Shape, mean energies (two decimals) and segments of stored features."""
    patches, spans = from_ipc(tensor)
    frames = -(-spans[-1][1] * RATE * UP // (HOP * 1000 * DOWN))
    mean = patches.reshape(-1, MELS)[:frames].astype(np.float64).mean(axis=0)
    voiced = sum(s["end_ms"] - s["start_ms"] for s in segments)
    return f"{'x'.join(map(str, patches.shape))}|{spans[-1][1]}ms|{' '.join(f'{m:.2f}' for m in mean + 0.0)}|{len(segments)} segments {voiced}ms"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches):
    for batch in batches:
        rows = []
        for media, tensor, spans in zip(batch.column("media"), batch.column("tensor"), batch.column("segments"), strict=True):
            media = media.as_py()
            _, payload = decode(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(tensor.as_py(), spans.as_py())))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def digests(extracted: DataFrame) -> DataFrame:
    """Digests of stored media and their features."""
    return extracted.mapInArrow(_digest, DIGEST)
