"""Audio columns: samples kept as 8-bit wave files, and features computed from the stored bytes.

Features are log-mel filterbanks over overlapped frames of a polyphase-resampled signal, cut into fixed-shape
tensors with their time spans, and segments found by an energy threshold with hysteresis.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C

RATE, UP, DOWN = 8000, 3, 4
FRAME, HOP, MELS, SPAN = 256, 128, 20, 64
#: A segment opens above HIGH and lasts while frames stay above LOW: decibels over the median frame energy.
HIGH, LOW = 1.5, 0.5
#: Samples handled at a time, a multiple of DOWN; bounds memory for long recordings and changes no value.
BLOCK = 1 << 20


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """A mono wave file of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wave(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def padded(text: str, unit: int = 192) -> tuple[int, bytes]:
    """The length of the text in bytes, and the bytes with blanks up to a positive multiple of unit."""
    raw = text.encode("utf-8")
    return len(raw), raw + b" " * (-len(raw) % unit or (unit if not raw else 0))


@lru_cache(4)
def _phases(up: int, down: int, taps: int = 24) -> np.ndarray:
    """The windowed-sinc low-pass as one row of taps for each phase, applied to a window of input samples."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    h *= up / h.sum()
    return h.reshape(taps, up).T[:, ::-1].astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, before: np.ndarray = np.zeros(0, np.float32), after: np.ndarray = np.zeros(0, np.float32)) -> np.ndarray:
    """Polyphase resampling by up / down: each output sample uses the taps of its phase only.

    ``before`` and ``after`` are what stands beside x in a longer signal, silence where they are short; x of a multiple of
    down samples gives the same values as in the whole.
    """
    h = _phases(up, down)
    taps = h.shape[1]
    n, reach = -(-len(x) * up // down), taps // 2
    before, after = before[-reach:], after[: taps + down]
    x = np.concatenate([np.zeros(reach - len(before), np.float32), before, x, after, np.zeros(taps + down - len(after), np.float32)])
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):
        k, at = len(out[first::up]), first * down // up
        total = np.zeros(k, np.float32)
        for tap in range(taps):  # tap by tap, so that a sum doesn't depend on how many are made at a time
            total += x[at + tap :: down][:k] * h[first * down % up, tap]
        out[first::up] = total
    return out


@lru_cache(4)
def _mel(rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triangular filters, even on the mel scale, over the bins of a frame: bins and their weights, and where each filter begins."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rise, fall = (bins - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - bins) / np.diff(edges)[1:]
    bank = np.maximum(0, np.minimum(rise, fall)).T
    bank[:, 0] += 1e-12  # no filter is empty
    band, at = np.nonzero(bank)
    return at, bank[band, at].astype(np.float32), np.searchsorted(band, np.arange(MELS))


def hysteresis(level: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Runs of frames above low that somewhere exceed high; ends exclusive."""
    on = np.concatenate([[0], (level > low).astype(np.int8), [0]])
    starts, ends = np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)
    if not len(starts):
        return []
    reach = np.concatenate([[0], np.cumsum(level > high)])
    return [(int(a), int(b)) for a, b in zip(starts, ends) if reach[b] > reach[a]]


def features(stored: bytes) -> dict:
    """tensor (spans, SPAN, MELS) of float32 log-mel energies, spans and segments as seconds, and the number of frames."""
    samples = np.frombuffer(from_wave(stored), dtype=np.uint8)
    rate = RATE * UP / DOWN
    mels, energies = [], []
    window, (bins, weights, bands) = np.hanning(FRAME).astype(np.float32), _mel(rate)
    rest = np.zeros(0, np.float32)
    signal = lambda a, b: (samples[max(a, 0) : max(b, 0)].astype(np.float32) - 128) / 128
    for at in range(0, len(samples), BLOCK):
        y = np.concatenate([rest, resample(signal(at, at + BLOCK), before=signal(at - FRAME, at), after=signal(at + BLOCK, at + BLOCK + FRAME))])
        if at + BLOCK >= len(samples):
            y = np.concatenate([y, np.zeros(max(0, FRAME - len(y)) or -(len(y) - FRAME) % HOP, np.float32)])
        if len(y) < FRAME:
            rest = y
            continue
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        rest = y[len(frames) * HOP :]
        power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
        mels.append(np.log(np.add.reduceat(power.astype(np.float32)[:, bins] * weights, bands, axis=1) + 1e-6))
        energies.append(10 * np.log10((frames * frames).mean(axis=1) + 1e-9))
    mel = np.concatenate(mels)
    level = np.concatenate(energies)
    n = len(mel)
    tensor = np.zeros((-(-n // SPAN), SPAN, MELS), np.float32)
    tensor.reshape(-1, MELS)[:n] = mel
    second = HOP / rate
    middle = float(np.median(level))
    return {
        "tensor": tensor, "n_frames": n,
        "spans": [(i * SPAN * second, min(n, (i + 1) * SPAN) * second) for i in range(len(tensor))],
        "segments": [(a * second, b * second) for a, b in hysteresis(level, middle + HIGH, middle + LOW)],
    }


def tensor_array(tensors: list[np.ndarray]) -> pa.Array:
    """Tensors of shape (SPAN, MELS) as Arrow's fixed-shape tensor type, for files that keep the shape."""
    values = np.stack(tensors) if tensors else np.zeros((0, SPAN, MELS), np.float32)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), SPAN * MELS)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (SPAN, MELS)), storage)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each time span of each text's recording.

    Columns: doc_id, span, start_s, end_s, tensor (SPAN * MELS floats, row by row; read with ``tensor_array``),
    active (share of the span inside a segment). Null counts as empty text, which is one padded unit; repeated rows
    and null ids stay as they are; an empty table gives an empty result. A text of any length is one recording.
    """
    schema = T.StructType.fromDDL("doc_id long, span int, start_s double, end_s double, tensor array<float>, active double")

    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = features(to_wave(padded(text or "")[1]))
                active = [sum(max(0.0, min(b, e) - max(a, s)) for s, e in f["segments"]) / (b - a) for a, b in f["spans"]]
                k = len(f["spans"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([a for a, _ in f["spans"]]), pa.array([b for _, b in f["spans"]]),
                    pa.array(list(f["tensor"].reshape(k, -1)), pa.list_(pa.float32())), pa.array(active)], names=schema.names)

    return _texts(C.spread(docs), id_col, text_col).mapInArrow(run, schema)


def audio_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: its lengths, digests of the payload read back and of the stored file, and of the features.

    ``feature`` is frames:spans:segments:digest of the fixed-shape tensor column, in 1/16 steps, and of the segments in seconds. Null
    counts as empty text; equal texts have equal values; repeated rows and null ids stay as they are; an empty table
    gives an empty result. A text of any length is one recording.
    """
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def row(text: str) -> tuple:
        n, payload = padded(text)
        stored = to_wave(payload)
        back, f = from_wave(stored), features(stored)
        kept = tensor_array(list(f["tensor"])).to_numpy_ndarray()
        steps = np.round(kept * 16).astype("<i2").tobytes() + repr([(round(a, 4), round(b, 4)) for a, b in f["segments"]]).encode()
        return n, len(back), sha(back), zlib.crc32(back[-16:]), len(stored), sha(stored), f"{f['n_frames']}:{len(f['spans'])}:{len(f['segments'])}:{sha(steps)[:32]}"

    def run(batches):
        for batch in batches:
            rows = [row(t or "") for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if k in (2, 5, 6) else pa.int64()) for k, c in enumerate(cols))], names=schema.names)

    return _texts(C.spread(docs), id_col, text_col).mapInArrow(run, schema)
