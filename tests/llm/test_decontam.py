import random

import pytest

from sensorloom.llm import decontam
from tests.llm.data import documents, empty, texts


def expected(docs, items, window=13):
    out = []
    pats: dict = {}
    for i, t in items:
        w = decontam.words_of((t or "").encode())
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            pats.setdefault(tuple(w[k : k + m]), set()).add("" if i is None else str(i))
    lengths = {len(p) for p in pats}
    for i, t, *_ in docs:
        w = decontam.words_of((t or "").encode())
        hit, own = set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in pats:
                    own |= pats[tuple(w[k : k + m])]
                    hit.update(range(k, k + m))
        out.append((str(i), len(w), len(hit), ",".join(sorted(own)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def items():
    rows = texts()
    long = [t for _, t, *_ in rows if t and 30 < len(t.split()) < 300]
    return [(1, long[0]), (2, long[3].upper()), (10, long[0]), (3, "a b c d"), (4, "thAN"), (5, ""), (6, None), (7, "q-w, e r t"), (None, long[5]), (8, "shared3 shared4 shared5 shared6 shared7 shared8 shared9 shared10 shared11 shared12 shared13 shared14 shared15 shared16")]


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_hits_equal_brute_force(spark, block_words):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    out = decontam.find_benchmark(documents(spark), bench, columns=["doc_id", "t", "score"], block_words=block_words).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r.hit_items), r.contaminated) for r in out) == expected(texts(), items())
    assert {r.t for r in out} == {"clash"}


def test_shifts_equal_scanning():
    r = random.Random(6)
    for _ in range(200):
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(40))]
        m = r.randrange(1, 6)
        patterns = {tuple(r.choice([b"a", b"b", b"c"]) for _ in range(m)): [k] for k in range(r.randrange(1, 5))}
        got = [(at, tuple(i)) for at, i in decontam.WuManber(m, patterns).search(words)]
        assert got == [(k, tuple(patterns[tuple(words[k : k + m])])) for k in range(len(words) - m + 1) if tuple(words[k : k + m]) in patterns]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_benchmark(empty(spark), none, columns=["doc_id"]).collect() == []
    out = decontam.find_benchmark(documents(spark), none, columns=["doc_id"]).collect()
    assert len(out) == len(texts()) and not any(r.contaminated or r.n_hit for r in out)
