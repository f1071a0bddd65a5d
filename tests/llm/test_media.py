import hashlib
import zlib

from pathlib import Path

import numpy as np

from relspark.llm import media
from relspark.llm.common import fresh_path


def test_wav_is_lossless():
    for data in (b"", b"a", bytes(range(256)) * 3):
        assert media.decode(media.encode(data)) == (media.RATE, data)
    import io
    import wave

    with wave.open(io.BytesIO(media.encode(b"abcd"))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(9)) == (1, 1, 8000, b"abcd")


def test_resample_like_upsampling_by_zeros():
    x = np.random.default_rng(0).normal(size=400).astype(np.float32)
    h = media.FILTER.T.ravel()
    wide = np.zeros(len(x) * media.UP)
    wide[:: media.UP] = x
    want = np.convolve(wide, h)[:: media.DOWN][: -(-len(x) * media.UP // media.DOWN)]
    assert np.allclose(media.resample(x), want, atol=1e-5)
    t = np.arange(4000)
    tone = media.resample(np.sin(2 * np.pi * 500 / 8000 * t).astype(np.float32))
    assert abs(np.argmax(np.abs(np.fft.rfft(tone))) * 6000 / len(tone) - 500) < 5


def test_hysteresis():
    mel = np.full((40, media.MELS), 0.0, np.float32)
    mel[10:20] += 0.2
    mel[12:14] -= 0.15
    mel[30:33] += 0.1
    found = media.segments_of(mel, upper=1.5, lower=0.2)
    assert found == [(10, 20)]


def test_tensor_round_trip():
    mel = np.random.default_rng(1).normal(size=(150, media.MELS)).astype(np.float32)
    patches, spans = media.from_ipc(media.to_ipc(media.patches_of(mel), len(mel)))
    assert patches.shape == (3, media.PATCH, media.MELS) and np.array_equal(patches.reshape(-1, media.MELS)[:150], mel)
    assert spans[0] == (0, media._ms(64)) and spans[-1][1] == media._ms(150)


def test_log_mel_by_definition():
    """Every sample is in a frame; energies as the discrete Fourier transform and the triangles on the mel scale say."""
    y = np.random.default_rng(3).normal(size=400).astype(np.float32)
    got = media.log_mel(y)
    starts = range(0, 400 - media.FRAME + media.HOP, media.HOP)
    assert len(got) == len(starts) and starts[-1] + media.FRAME >= 400
    rate = media.RATE * media.UP / media.DOWN
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (to_mel(rate / 2) * i / (media.MELS + 1) / 2595) - 1) for i in range(media.MELS + 2)]
    bins = np.arange(media.FFT // 2 + 1)
    wave = np.exp(-2j * np.pi * np.outer(bins, np.arange(media.FRAME)) / media.FFT)
    for row, start in zip(got, starts, strict=True):
        frame = np.zeros(media.FRAME)
        own = y[start : start + media.FRAME]
        frame[: len(own)] = own
        power = np.abs(wave @ (frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1))))) ** 2
        for m in range(media.MELS):
            weight = [max(0.0, min((f - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - f) / (edges[m + 2] - edges[m + 1]))) for f in bins * rate / media.FFT]
            assert abs(row[m] - np.log10(power @ weight + 1e-6)) < 1e-3
    assert media.log_mel(np.zeros(3, np.float32)).shape == (1, media.MELS) and len(media.log_mel(np.zeros(media.FRAME, np.float32))) == 1


def test_feature_text_by_hand():
    mel = np.full((70, media.MELS), 0.5, np.float32)
    mel[:, 0] = -1.25
    text = media.feature_text(media.to_ipc(media.patches_of(mel), 70), [{"start_ms": 10, "end_ms": 30}, {"start_ms": 50, "end_ms": 60}])
    assert text == f"2x64x20|{70 * media.HOP * 1000 * media.DOWN // (media.RATE * media.UP)}ms|-1.25 {' '.join(['0.50'] * 19)}|2 segments 30ms"


def test_features_come_from_the_files(spark):
    """What is stored decides: features of files with other samples are those of the other samples."""
    docs = spark.createDataFrame([(1, "abc " * 500)], "doc_id long, text string")
    path = fresh_path(spark, "media")
    stored = media.store(docs, path)
    (row,) = stored.collect()
    other = media.encode(bytes(reversed(media.decode(row.media)[1])))
    changed = spark.createDataFrame([(1, row.n_bytes, other)], media.STORED)
    (got,) = media.digests(media.extract(changed)).collect()
    assert got.feature == media.feature_text(*_features(other)) and len(list(Path(path.removeprefix("file:")).glob("*.parquet"))) >= 1


def _features(wav):
    tensor, spans = media.features(wav)
    return tensor, [{"start_ms": a, "end_ms": b} for a, b in spans]


def test_awkward_rows(spark, awkward, nothing):
    texts = {r.doc_id: r.text for r in awkward.filter("doc_id is not null").collect()}
    extract = lambda df: media.extract(media.store(df, fresh_path(spark, "media")))
    stored = extract(awkward).collect()
    rows = media.digests(extract(awkward)).collect()
    assert len(rows) == len(stored) == 12
    for r in rows:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
            assert r.tail_crc32 == zlib.crc32(padded[-32:]) and r.media_bytes == len(media.encode(padded))
    assert len({tuple(r)[1:] for r in rows if r.doc_id in (1, 2)}) == 1 and len({tuple(r)[1:] for r in rows if r.doc_id in (3, 4)}) == 1
    assert extract(nothing).count() == 0
