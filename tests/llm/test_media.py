import hashlib
import zlib

import numpy as np
import pyarrow as pa

from sensorloom.llm import media
from tests.llm.data import documents, empty, texts

S = media.Settings()


def test_payload_comes_back(spark):
    rows = texts()
    got = media.media_columns(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want.append((str(i), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    for r in got:
        assert hashlib.sha256(media.load(bytes(r.media))).hexdigest() == r.payload_sha256
        assert len(media.load(bytes(r.media))) % 192 == 0


def test_tensors_have_a_fixed_shape_and_spans(spark):
    for r in media.media_columns(documents(spark, texts()[:30])).collect():
        table = pa.ipc.open_stream(bytes(r.tensors)).read_all()
        assert table.schema.field("log_mel").type.shape == [S.patch, S.mels]
        assert table["start_ms"][0].as_py() == 0
        assert all(a < b for a, b in zip(table["start_ms"].to_pylist(), table["end_ms"].to_pylist()))
        assert all(x.start_ms < x.end_ms for x in r.spans)


def test_resampling_equals_direct_filtering():
    rng = np.random.default_rng(5)
    x = rng.normal(size=600).astype(np.float32)
    taps = np.zeros(S.taps * S.up)
    for p, h in enumerate(media._phases(S)):
        taps[p :: S.up] = h
    up = np.zeros(len(x) * S.up)
    up[:: S.up] = x
    want = np.convolve(up, taps)[:: S.down][: len(x) * S.up // S.down]
    assert np.allclose(media.resample(x, S), want, atol=1e-5)


def test_a_tone_keeps_its_pitch():
    t = np.arange(12_000) / S.rate
    mels, energy = media.log_mel(media.resample(np.sin(2 * np.pi * 1000 * t).astype(np.float32), S), S)
    centres = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + S.out_rate / 2 / 700), S.mels + 2) / 2595) - 1)[1:-1]
    assert abs(centres[mels[5:-5].mean(axis=0).argmax()] - 1000) < 120
    assert len(mels) == len(energy)


def test_hysteresis():
    e = np.array([0, 0, 2, 0.5, 0, -0.5, -3, 0.5, 3, 0, 0], float)
    assert media.spans(e, S) == [(2, 6), (8, 11)]
    assert media.spans(np.zeros(4), S) == []


def test_equal_texts_and_empty(spark):
    got = media.media_digest(media.media_columns(documents(spark))).collect()
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(v) == 1 for v in by.values())
    assert media.media_columns(empty(spark)).collect() == []
