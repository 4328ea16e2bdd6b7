import hashlib

import numpy as np
import pytest
import xxhash

from sensorloom.llm import substring
from sensorloom.llm.fm_index import BitVector, FMIndex
from tests.llm.data import WORD, documents, empty, texts


def text_key(t):
    """Spark's hash of a text, which orders the texts of one id."""
    return 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), seed=42)).astype(np.int64))


def expected(rows, window=20):
    keyed = sorted({(i is None, i or 0, text_key(t), t or "") for i, t, *_ in rows})
    first, out = {}, {}
    for no, (none, i, dig, t) in enumerate(keyed):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), (no, k)) != (no, k):
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[none, i, t] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return sorted(((i, *out[i is None, i or 0, t or ""]) for i, t, *_ in rows), key=str)


@pytest.mark.parametrize("hot", [1000, 1])
def test_removed_words_equal_brute_force(spark, hot):
    rows = texts(n=60)
    out = substring.drop_repeats(documents(spark, rows), hot=hot, shard_words=500).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == expected(rows)
    assert all(r.kept is not None and len(r.kept.split()) == r.n_words - r.n_removed for r in out if r.n_removed)
    assert all(sum(x.last - x.first + 1 for x in r.spans) == r.n_removed for r in out)
    whole = {(r.doc_id, r.kept_sha256): r.spans for r in out}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        kept = [[x for k, x in enumerate(w) if not any(s.first <= k <= s.last for s in spans)] for (d, _), spans in whole.items() if d == i]
        assert any((i, hashlib.sha256(" ".join(k).encode()).hexdigest()) in whole for k in kept)


def test_periodic_texts(spark):
    rows = [(k, t, "en", "a") for k, t in enumerate(["for " * 300, "x " + "for " * 25 + "y", "a b " * 60, "b a " * 15 + "end", " ".join(f"w{j % 9}" for j in range(90)), "for " * 19, "for " * 20])]
    out = substring.drop_repeats(documents(spark, rows), with_text=False).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == expected(rows)


def test_empty_table(spark):
    assert substring.drop_repeats(empty(spark)).collect() == []


def test_backward_search_equals_scanning():
    rng = np.random.default_rng(3)
    parts = [rng.integers(1, 4, n) for n in (30, 25, 7, 40)]
    text = np.concatenate([np.r_[0, p] for p in parts] + [[0]])
    index = FMIndex(text)
    ends = np.array([e for e in range(6, len(text)) if 0 not in text[e - 6 : e]])
    matched, lo, hi = index.search(text, ends, 6)
    for e, m, a, b in zip(ends, matched, lo, hi):
        counts = [sum((text[s : s + k] == text[e - k : e]).all() for s in range(len(text) - k + 1)) for k in range(1, 7)]
        assert m == max([k for k, c in enumerate(counts, 1) if c > 1], default=0)
        if m == 6:
            assert b - a == counts[5]
            assert all((text[s : s + 6] == text[e - 6 : e]).all() for s in index.locate(np.arange(a, b)))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 1 << 62, 50).astype(np.uint64), rng.integers(0, 1 << 62, 70).astype(np.uint64)
    b[30:55] = a[10:35]

    def anchors(h):
        key, first, n, places = substring.segments(h, 20)
        return np.repeat(key, n)

    assert (anchors(a)[10:16] == anchors(b)[30:36]).all()


def test_bits_and_positions_of_the_compressed_index():
    rng = np.random.default_rng(8)
    for density in (0.0, 0.01, 0.5, 1.0):
        bits = np.repeat(rng.random(40) < density, rng.integers(1, 300, 40))
        v = BitVector(bits).opened()
        at = np.arange(len(bits) + 1)
        assert (v.rank(at) == np.r_[0, np.cumsum(bits)]).all() and (v.get(at[:-1]) == bits).all()
    symbols = np.r_[0, np.tile(np.r_[rng.integers(1, 50, 400), 0], 40)]
    index = FMIndex(symbols)
    assert sorted(index.locate(np.arange(index.n)).tolist()) == list(range(len(symbols) + 1))
    plain = 8 * len(symbols) + sum(12 * len(symbols) // 64 for _ in index.tree.levels)
    assert index.nbytes() < plain / 5  # repeats are runs in the transform


def test_rows_of_one_id_and_null_ids(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(1, "a " + passage, "en", "a"), (1, "b " + passage, "en", "a"), (1, "b " + passage, "en", "a"), (None, passage + " c", "en", "a"), (None, passage + " c", "en", "a"), (2, passage, "en", "a"), (2, None, "en", "a")]
    out = substring.drop_repeats(documents(spark, rows), with_text=False).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == expected(rows)
