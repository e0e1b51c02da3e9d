"""Media columns: texts as 8-bit audio, and audio features of what was stored.

A payload is a text's UTF-8 bytes with bytes 0 up to a positive multiple of 64. It is stored as a WAV file of 8-bit
mono samples, which holds the bytes as they are. Features come from the stored file only: polyphase resampling by a
windowed sinc, overlapped frames, log-mel filterbank energies, and segments by energy with hysteresis (a segment
starts above one level and ends below a lower one). Features are kept as Arrow columns of fixed-shape tensors,
[FRAMES, MELS] of float32 with time spans, the last one filled up with the floor value; the query's summary is read
from them.

Nulls and edges: a null text is an empty one, whose payload is 64 bytes 0; equal texts have equal values whatever
else is in the batch; a file that is no such WAV raises ValueError; repeated rows are stored one by one; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import binary, slices

RATE, UP, DOWN, TAPS = 16000, 1, 2, 16
WINDOW_MS, HOP_MS, MELS, FRAMES = 32, 16, 32, 64
#: A segment starts above and ends below these shares of the way from the 10th to the 95th percentile of energy.
START, END, FLOOR_DB = 0.6, 0.3, -80.0
_HEAD = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def encode(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit mono samples; an odd number is followed by a byte of padding."""
    n = len(samples)
    return _HEAD.pack(b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + samples + bytes(n % 2)


def decode(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV file that encode() wrote."""
    if len(media) < _HEAD.size:
        raise ValueError("not a WAV file")
    riff, _, wave, _, _, kind, channels, rate, _, _, bits, data, n = _HEAD.unpack_from(media)
    if (riff, wave, kind, channels, bits, data) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or len(media) < _HEAD.size + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[_HEAD.size : _HEAD.size + n], rate


def polyphase(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """A windowed-sinc low pass as one filter a phase: [up, taps]."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hamming(n) * up
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, bank: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up / down times its rate; only the outputs that are kept are computed."""
    taps = bank.shape[1]
    n = -(-len(x) * up // down)
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(x, (taps - 1, taps)), taps)
    out = np.empty(n, np.float32)
    for a in range(0, n, 1 << 17):
        at = np.arange(a, min(n, a + (1 << 17))) * down
        out[a : a + len(at)] = np.einsum("nt,nt->n", wide[at // up], bank[at % up])
    return out


def mel_bank(rate: int, size: int, mels: int = MELS) -> np.ndarray:
    """Triangular filters over the bins of a real FFT, even on the mel scale: [bins, mels]."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


class Extractor:
    """Filters made once a task."""

    def __init__(self, rate: int = RATE):
        self.rate = rate * UP // DOWN
        self.size, self.hop = self.rate * WINDOW_MS // 1000, self.rate * HOP_MS // 1000
        self.bank, self.mels = polyphase(), mel_bank(self.rate, self.size)
        self.window = np.hanning(self.size).astype(np.float32)

    def log_mel(self, samples: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Log-mel energies [frames, MELS] and the frames' energies in dB; long audio goes block by block."""
        x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
        y = resample(x, self.bank)
        n = max(1, -(-(len(y) - self.size) // self.hop) + 1)
        y = np.pad(y, (0, max(0, (n - 1) * self.hop + self.size - len(y))))
        frames = np.lib.stride_tricks.sliding_window_view(y, self.size)[:: self.hop]
        mel, db = [], []
        for at in range(0, n, 4096):
            f = frames[at : min(n, at + 4096)]
            db.append(10 * np.log10(f.var(1) + 1e-8))
            power = np.abs(np.fft.rfft(f * self.window, axis=1)).astype(np.float32) ** 2
            mel.append(10 * np.log10(power @ self.mels / self.size + np.float32(1e-8)))
        return np.concatenate(mel), np.concatenate(db)

    def segments(self, db: np.ndarray) -> list[tuple[int, int]]:
        """(start_ms, end_ms) where energy rose to the upper level, until it fell below the lower one."""
        low, high = np.percentile(db, (10, 95))
        state = np.where(db >= low + START * (high - low), 1, np.where(db < low + END * (high - low), 0, -1))
        last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(db)), -1))
        on = np.r_[0, np.where(last >= 0, state[np.maximum(last, 0)], 0), 0]
        edge = np.diff(on)
        return [(int(a) * HOP_MS, int(b) * HOP_MS) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def tensors(mel: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """[n, FRAMES, MELS] and the time span of each in ms."""
    n = -(-len(mel) // FRAMES)
    out = np.full((n * FRAMES, MELS), FLOOR_DB, np.float32)
    out[: len(mel)] = mel
    return out.reshape(n, FRAMES, MELS), [(i * FRAMES * HOP_MS, min(len(mel), (i + 1) * FRAMES) * HOP_MS) for i in range(n)]


def tensor_type() -> pa.FixedShapeTensorType:
    return pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS], dim_names=["frame", "mel"])


def tensor_column(mel: np.ndarray) -> tuple[pa.ExtensionArray, list[tuple[int, int]]]:
    """Log-mel energies as an Arrow column of fixed-shape tensors, with the time span of each."""
    t, spans = tensors(mel)
    return pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(pa.array(t.ravel()), FRAMES * MELS)), spans


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as an audio file."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = binary(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(payload(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fn, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Fixed-shape tensors of a media column, one row each: doc_id, part, start_ms, end_ms, log_mel, segments.

    log_mel has FRAMES * MELS values in row order; arrow_tensors() gives it Arrow's fixed-shape tensor type.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Extractor()
        for batch in slices(batches, 1 << 20):
            ids, parts, spans, data, segs = [], [], [], [], []
            for d, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                mel, db = make.log_mel(decode(m)[0])
                t, s = tensor_column(mel)
                all_segments = make.segments(db)
                ids += [d] * len(t)
                parts += range(len(t))
                spans += s
                data.append(t.storage.flatten().to_numpy())
                segs += [[{"start_ms": max(a, x), "end_ms": min(b, y)} for a, b in all_segments if a < y and b > x] for x, y in s]
            flat = np.concatenate(data) if data else np.empty(0, np.float32)
            log_mel = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, FRAMES * MELS, dtype=np.int32), flat)
            kind = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
            cols = [pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64()), log_mel, pa.array(segs, kind)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "start_ms", "end_ms", "log_mel", "segments"])

    return media.select("doc_id", "media").mapInArrow(fn, "doc_id long, part long, start_ms long, end_ms long, log_mel array<float>, segments array<struct<start_ms: long, end_ms: long>>")


def arrow_tensors(table: pa.Table) -> pa.Table:
    """The log_mel column of features() as Arrow's fixed-shape tensor [FRAMES, MELS] of float32."""
    flat = pa.concat_arrays([c.flatten() for c in table.column("log_mel").chunks] or [pa.array([], pa.float32())])
    storage = pa.FixedSizeListArray.from_arrays(flat.cast(pa.float32()), FRAMES * MELS)
    return table.set_column(table.schema.get_field_index("log_mel"), "log_mel", pa.ExtensionArray.from_storage(tensor_type(), storage))


def summary(column: pa.ExtensionArray, spans: list[tuple[int, int]], segs: list[tuple[int, int]]) -> str:
    """Tensors, segments, their time, and each band's mean level in whole dB over the frames of the spans."""
    frames = column.to_numpy_ndarray().reshape(-1, MELS)[: spans[-1][1] // HOP_MS]
    bands = "/".join(str(int(x)) for x in np.rint(frames.mean(0, dtype=np.float64)))
    return f"tensors={len(column)}x{FRAMES}x{MELS};end_ms={spans[-1][1]};segments={len(segs)};active_ms={sum(b - a for a, b in segs)};mel={bands}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """What a media column (doc_id, n_bytes, media) reads back as, with a summary of its features."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, sha = Extractor(), lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches):
            rows = []
            for m in batch.column("media").to_pylist():
                samples, _ = decode(m)
                mel, db = make.log_mel(samples)
                rows.append((len(samples), sha(samples), zlib.crc32(samples[-64:]), len(m), sha(m), summary(*tensor_column(mel), make.segments(db))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [x.split()[0] for x in SCHEMA.split(", ")])

    return media.mapInArrow(fn, SCHEMA)


def audio(docs: DataFrame) -> DataFrame:
    return digests(store(docs))
