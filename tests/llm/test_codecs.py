import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindle.llm import audio, bpe

VOCAB = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, tie long"
HARD = [
    None, "", " ", "\n\n  x", "it's we'll DON'T 's'", "a  b   c\t\td \r\n", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>z",
    "Ééa ñ ß 中文字 日本 12³४ ⅷ   x　", "\x1c\x1f \x85 a​", "🙂👩‍👩‍👧 é", "a" * 5000, "!?" * 3000, " " * 4000, "ab1" * 2000, "�\x00\x7f", "The  quick\n brown fox.",
]


def _reference():
    return Tokenizer.from_file(VOCAB)


def _ids(text):
    return np.frombuffer(bpe.codec(VOCAB).encode(text), dtype="<u4").tolist()


def test_encodes_hard_texts_as_the_library():
    t = _reference()
    for text in HARD[1:]:
        assert _ids(text) == t.encode(text, add_special_tokens=False).ids, text[:40]
        assert bpe.codec(VOCAB).decode(bpe.codec(VOCAB).encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encodes_any_text_as_the_library(text):
    ids = _reference_cached.encode(text, add_special_tokens=False).ids
    assert _ids(text) == ids
    assert bpe.codec(VOCAB).decode(bpe.codec(VOCAB).encode(text)) == _reference_cached.decode(ids, skip_special_tokens=False)


_reference_cached = _reference()


def test_boundaries_stand_inside_no_token():
    c = bpe.codec(VOCAB)
    assert all(t[i : i + 2] not in c.boundary for t in c.tokens[:50256:7] for i in range(len(t) - 1))
    assert b"e " in c.boundary


def test_round_trip_and_tables(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(HARD)] + [(None, "twice", None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted(map(tuple, bpe.round_trip(docs, VOCAB).collect()), key=str)
    t = _reference()
    want = []
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want, key=str)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, VOCAB), VOCAB).collect()}
    assert all(back[i] == (text or "") for i, text, *_ in rows)
    assert bpe.round_trip(docs.limit(0), VOCAB).count() == 0


def test_audio_digest(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "x" * 192, "é" * 200, "".join(rng.choices("ab \n", k=30000))]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a", "y", 2)] * 2
    found = audio.audio_digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        raw = (dict((i, t) for i, t, *_ in rows)[r.doc_id] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_bytes == 44 + len(payload)
    assert len({r.feature for r in found if r.doc_id in (2, None)}) == 1
    assert audio.audio_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_resampling_agrees_with_direct_filtering():
    x = np.random.default_rng(0).standard_normal(500).astype(np.float32)
    up, down = 3, 4
    h = audio._phases(up, down)
    full = h[:, ::-1].T.reshape(-1)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    y = np.convolve(stuffed, full)
    got = audio.resample(x)
    offset = np.argmax([abs(np.corrcoef(y[o::down][: len(got) - 20], got[: len(y[o::down][: len(got) - 20])])[0, 1]) for o in range(60)])
    assert np.allclose(y[offset::down][: len(got) - 20], got[: len(got) - 20], atol=1e-4)
    tone = np.sin(np.arange(8000) * 2 * np.pi * 440 / 8000).astype(np.float32)
    y = audio.resample(tone)
    assert abs(np.argmax(np.abs(np.fft.rfft(y))) * 6000 / len(y) - 440) < 2


def test_spans_and_hysteresis(spark):
    assert audio.hysteresis(np.array([0, 2, 4, 2, 0, 2, 2, 0]), 3, 1) == [(1, 4)]
    rows = audio.audio_features(spark.createDataFrame([(1, "loud QUIET " * 4000), (2, None)], "doc_id long, text string")).orderBy("doc_id", "span").collect()
    assert all(len(r.tensor) == audio.SPAN * audio.MELS and r.end_s > r.start_s for r in rows)
    assert [r.start_s for r in rows if r.doc_id == 1][1] == rows[0].end_s
    array = audio.tensor_array([np.array(r.tensor, np.float32).reshape(audio.SPAN, audio.MELS) for r in rows])
    assert array.type.shape == [audio.SPAN, audio.MELS] and isinstance(array.type, pa.FixedShapeTensorType)


@pytest.mark.parametrize("n", [1, 300, 12_345, 40_000])
def test_blocks_change_nothing(monkeypatch, n):
    raw = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    whole = audio.features(audio.to_wave(raw))
    for block in (64, 4096, 20_000):
        monkeypatch.setattr(audio, "BLOCK", block)
        part = audio.features(audio.to_wave(raw))
        assert part["tensor"].tobytes() == whole["tensor"].tobytes() and part["segments"] == whole["segments"] and part["spans"] == whole["spans"]


def test_log_mel_by_direct_computation():
    raw = np.random.default_rng(3).integers(0, 256, 5000).astype(np.uint8)
    y = audio.resample((raw.astype(np.float32) - 128) / 128).astype(float)
    y = np.concatenate([y, np.zeros(-(len(y) - audio.FRAME) % audio.HOP)])
    rate = audio.RATE * audio.UP / audio.DOWN
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * k / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    got = audio.features(audio.to_wave(raw.tobytes()))
    assert got["n_frames"] == (len(y) - audio.FRAME) // audio.HOP + 1
    for frame in (0, 7, got["n_frames"] - 1):
        x = y[frame * audio.HOP : frame * audio.HOP + audio.FRAME] * [0.5 - 0.5 * math.cos(2 * math.pi * i / (audio.FRAME - 1)) for i in range(audio.FRAME)]
        power = [abs(sum(v * np.exp(-2j * math.pi * k * i / audio.FRAME) for i, v in enumerate(x))) ** 2 for k in range(audio.FRAME // 2 + 1)]
        for band in range(audio.MELS):
            lo, mid, hi = edges[band : band + 3]
            total = sum(p * max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for p, f in zip(power, (k * rate / audio.FRAME for k in range(len(power)))))
            assert abs(got["tensor"].reshape(-1, audio.MELS)[frame, band] - math.log(total + 1e-6)) < 0.01
