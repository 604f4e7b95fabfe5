"""Media columns: 8-bit PCM audio as WAVE bytes, and features of it as fixed-shape Arrow tensors with time spans.

Features of one clip: the samples are brought to half the rate by a polyphase FIR filter,
cut into overlapped Hann frames, turned into log-mel energies and laid out as patches of
``PATCH`` frames by ``BANDS`` bands (the last one padded with the floor); frames are grouped
into active segments by hysteresis on their energy.  Patches and spans are one Arrow IPC
stream: a ``fixed_shape_tensor`` column with start and end seconds.

Defined results: null counts as empty; a clip of any length gives at least one frame; equal
bytes give equal media, features and spans; other columns pass through.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches, without

RATE, DOWN, TAPS = 8000, 2, 32
FRAME, HOP, BANDS, PATCH = 256, 128, 24, 32
FLOOR = 1e-6
#: Energy (mean square) at which a segment begins and ends.
ON, OFF = 0.050, 0.035
ALIGN = 64
#: Samples worked on at once; a longer clip is cut at frame borders.
BLOCK = 1 << 20


def payload_of(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % ALIGN if raw else ALIGN)


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """Mono 8-bit PCM in a RIFF container; every sample byte is kept as it is."""
    pad = len(samples) % 2
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples))
    return b"RIFF" + struct.pack("<I", len(head) + len(samples) + pad) + head + samples + bytes(pad)


def from_wave(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of mono 8-bit PCM, found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE stream")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=4)
def low_pass(taps: int = TAPS, down: int = DOWN) -> np.ndarray:
    """Windowed-sinc filter for decimation, its gain 1 at zero frequency."""
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(t / down) * np.hamming(taps)
    return (h / h.sum()).astype(np.float32)


def resample(samples: np.ndarray, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Every ``down``-th output of the filter, computed branch by branch so that nothing is filtered in vain."""
    h = low_pass(taps, down)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), samples, np.zeros(taps, np.float32)])
    n = -(-len(samples) // down)
    out = np.zeros(n, np.float32)
    for branch in range(down):
        line, part = padded[branch::down], h[branch::down]
        out += np.convolve(line, part[::-1], "valid")[:n]
    return out


@lru_cache(maxsize=4)
def mel_bank(rate: int, frame: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """Triangular filters, evenly spaced in mels from 0 to half the rate."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    hz = np.arange(frame // 2 + 1) * rate / frame
    rise = (hz[:, None] - edges[:-2]) / np.diff(edges)[:-1]
    fall = (edges[2:] - hz[:, None]) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(signal: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames x bands log-mel energies, mean square per frame)."""
    n = max(1, -(-max(0, len(signal) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(signal)] = signal
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    mels, energy, bank, window = np.empty((n, BANDS), np.float32), np.empty(n, np.float32), mel_bank(rate), np.hanning(FRAME).astype(np.float32)
    step = BLOCK // FRAME
    for i in range(0, n, step):
        part = frames[i : i + step]
        spectrum = np.fft.rfft(part * window, axis=1)
        mels[i : i + step] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + FLOOR)
        energy[i : i + step] = np.einsum("ij,ij->i", part, part) / FRAME
    return mels, energy


def segments(energy: np.ndarray, on: float = ON, off: float = OFF) -> list[tuple[int, int]]:
    """[first, last + 1) frames that are active: from a frame of at least ``on`` until one below ``off``."""
    state = np.where(energy >= on, 1, np.where(energy < off, 0, -1))
    known = np.flatnonzero(state >= 0)
    at = np.searchsorted(known, np.arange(len(energy)), side="right") - 1
    active = np.where(at >= 0, state[known[at]] if len(known) else 0, 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active, [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def features(samples: bytes, rate: int) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]]]:
    """(patches x PATCH x BANDS tensor, start and end seconds of patches, active spans in seconds)."""
    signal = resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128)
    mels, energy = log_mel(signal, rate // DOWN)
    seconds, n = HOP * DOWN / rate, -(-len(mels) // PATCH)
    tensor = np.full((n * PATCH, BANDS), np.log(np.float32(FLOOR)), np.float32)
    tensor[: len(mels)] = mels
    starts = np.arange(n) * PATCH * seconds
    ends = np.minimum(starts + PATCH * seconds, len(samples) / rate)
    return tensor.reshape(n, PATCH, BANDS), np.stack([starts, ends], 1), [(a * seconds, b * seconds) for a, b in segments(energy)]


def to_tensors(tensor: np.ndarray, times: np.ndarray) -> bytes:
    """Arrow IPC stream: one row per patch with its fixed-shape tensor and time span."""
    kind = pa.fixed_shape_tensor(pa.float32(), tensor.shape[1:])
    storage = pa.FixedSizeListArray.from_arrays(pa.array(tensor.reshape(-1)), int(np.prod(tensor.shape[1:])))
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, storage), pa.array(times[:, 0]), pa.array(times[:, 1])], ["log_mel", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    table = pa.ipc.open_stream(stream).read_all()
    return table.column("log_mel").combine_chunks().to_numpy_ndarray(), np.stack([table.column(c).to_numpy() for c in ("start_s", "end_s")], 1)


FIELDS = [
    T.StructField("media", T.BinaryType()),
    T.StructField("log_mel", T.BinaryType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))),
]


def audio_column(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs' other columns with media (WAVE), log_mel (tensor stream) and spans (active segments) in place of ``column``."""
    docs = without(docs, *(f.name for f in FIELDS if f.name != column))
    at, others = docs.columns.index(column), [f for f in docs.schema.fields if f.name != column]
    schema = T.StructType([*others, *FIELDS])
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 128):
                batch = whole.slice(first, 128)
                media, tensors, active = [], [], []
                for value in batch.column(at).to_pylist():
                    raw = value if isinstance(value, bytes) else (value or "").encode("utf-8", "surrogatepass")
                    media.append(stored := to_wave(payload_of(raw)))
                    tensor, times, found = features(*from_wave(stored))
                    tensors.append(to_tensors(tensor, times))
                    active.append([{"start_s": a, "end_s": b} for a, b in found])
                kept = [c for i, c in enumerate(batch.columns) if i != at]
                new = [pa.array(media, pa.binary()), pa.array(tensors, pa.binary()), pa.array(active, spans)]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*(f.name for f in others), *(f.name for f in FIELDS)])

    return small_batches(docs).mapInArrow(make, schema)


def wave_payload(media) -> tuple[object, object]:
    """Column expressions: the sample bytes read back from WAVE bytes as ``to_wave`` lays them out, and their number."""
    from pyspark.sql import functions as F

    size = F.conv(F.concat(*[F.hex(F.substring(media, i, 1)) for i in (44, 43, 42, 41)]), 16, 10).cast("int")
    return F.substring(media, F.lit(45), size), size
