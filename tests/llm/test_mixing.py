import numpy as np

from sensorloom.llm import mixing
from tests.llm.data import WORD, documents, empty, texts


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, held = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in held)
        total = sum(w[s] for s in names if s not in held)
        target = {s: 2 * sizes[s] if s in held else left * w[s] / total for s in names}
        over = {s for s in names if s not in held and target[s] > 2 * sizes[s]}
        if not over:
            return target
        held |= over


def test_targets_rates_and_copies(spark):
    rows = texts()
    docs = documents(spark, rows)
    out = mixing.mix_sources(docs)
    assert {"t", "i", "u", "label", "picks"} <= set(out.columns)
    got = out.collect()
    assert len(got) == len(rows)
    count = lambda t: len(WORD.findall(t or ""))
    assert {r["size"] for r in got} == {"big"}  # the input's own column
    assert sorted((str(r.doc_id), str(r.text)[:50], r.mix_size) for r in got) == sorted((str(i), str(t)[:50], count(t)) for i, t, *_ in rows)
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    target = expected_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) for r in mine)
        taken = sum(r.taken for r in mine)
        assert abs(taken - target[s]) <= 0.02 * target[s] + 5
    assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.mix_size for r in got)


def test_rates_are_tilted_exponentials(spark):
    slopes: dict = {}
    for r in mixing.mix_sources(documents(spark)).collect():
        if r.mix_size > 0 and r.rate < 2:
            slopes.setdefault(r.source, []).append(np.log(r.rate) / r.mix_size)
    assert slopes and all(np.allclose(x, x[0], atol=1e-9) for x in slopes.values())


def test_reruns_agree(spark):
    take = lambda d: sorted((str(r.doc_id), str(r.text)[:40], r.taken) for r in mixing.mix_sources(d).collect())
    assert take(documents(spark)) == take(documents(spark).repartition(5))


def test_many_small_documents_meet_targets_closely(spark):
    rows = [(k, "word " * (1 + k % 17), "en", "abcdef"[k % 6]) for k in range(3000)]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    for s in "abcdef":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2


def test_copies_and_empty(spark):
    mixed = mixing.mix_sources(documents(spark))
    copies = mixing.mixed_copies(documents(spark))
    assert copies.columns == documents(spark).columns and copies.count() == sum(r.copies for r in mixed.collect())
    assert mixing.mix_sources(empty(spark)).collect() == []


def test_columns_of_every_added_name_survive(spark):
    rows = [(k, "word " * (1 + k % 9), "ab"[k % 2], *[1000 + k] * 6) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} long" for c in mixing.ADDED))
    out = mixing.mix_sources(docs)
    assert out.columns == [*docs.columns, *[f"mix_{c}" for c in mixing.ADDED]]
    assert all(r["size"] == r.taken == 1000 + r.doc_id and r.mix_size == 1 + r.doc_id % 9 for r in out.collect())
    assert all(r["size"] == r.target == 1000 + r.doc_id for r in mixing.mixed_copies(docs).collect())


def test_rates_are_the_optimum_of_the_dual(spark):
    """Of rates that meet a source's target, those of least relative entropy to 1, by bisection."""
    rows = [(k, "word " * (1 + 7 * k % 23), None, "abc"[k % 3]) for k in range(500)]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    for s in "abc":
        mine = [r for r in got if r.source == s]
        sizes, lo, hi = np.array([r.mix_size for r in mine], float), -50.0, 50.0
        for _ in range(200):
            lam = (lo + hi) / 2
            lo, hi = (lam, hi) if (np.minimum(2, np.exp(lam * sizes)) * sizes).sum() < mine[0].target else (lo, lam)
        assert np.allclose([r.rate for r in mine], np.minimum(2, np.exp(lam * sizes)), atol=1e-6)
