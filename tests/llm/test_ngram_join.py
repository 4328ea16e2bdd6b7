import random

import numpy as np

from sensorloom.llm import catalog, ngram_join, repeats
from sensorloom.llm.components import components
from tests.compare import connection, difference
from tests.llm.data import documents, empty, folded, texts


def expected(rows):
    sets = []
    for i, t, *_ in rows:
        w = folded(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    label = {}
    ids = sorted({i for i, s in sets if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for a in range(len(known)):
        for b in range(a):
            (i, x), (j, y) = known[a], known[b]
            c = len(x & y)
            if c and 100 * c >= 80 * (len(x) + len(y) - c):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    for i, s in sets:
        label[i] = (len(s), None if i is None else find(i))
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def test_components_equal_brute_force(spark):
    rows = texts()
    out = ngram_join.jaccard_components(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == expected(rows)


def test_small_sets_meet_by_subsets(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(n) if j != skip), "en", "a") for k, (n, skip) in enumerate([(9, -1), (10, -1), (9, 0), (8, -1), (7, 3), (5, -1), (4, -1), (4, -1), (12, 11), (12, -1)])]
    out = ngram_join.jaccard_components(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == expected(rows)


def test_empty_table(spark):
    assert ngram_join.jaccard_components(empty(spark)).collect() == []


def test_boundary_follows_cost():
    assert ngram_join.boundary({}) == 1
    assert ngram_join.boundary({3: (1000, 2000)}) > 3  # one subset beats two list entries
    assert ngram_join.boundary({10: (1000, 6000)}) <= 10  # pairs: lists are cheaper than 56 subsets
    assert ngram_join.boundary({10: (1000, 3_000_000)}) > 10  # a thousand copies: subsets are cheaper
    assert ngram_join.boundary({65: (1000, 10**9)}) == 1  # large sets never enumerate


def test_light_side_takes_the_small_sets_of_long_lists(spark):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice("ab") for _ in range(12)), "en", "a") for k in range(400)]  # up to 8 shingles of 32
    rows += [(1000 + k, " ".join(f"v{j}" if j > 0 else f"own{k}" for j in range(40)), "en", "a") for k in range(100)]  # 36 shingles, 35 shared
    docs = documents(spark, rows)
    _, classes, sets, labels = ngram_join._classes(docs, "doc_id", "text", 5)
    lists, below = ngram_join._lists(sets, 5)
    light = lists.filter("place = 0").select("sid").distinct().count()
    assert 8 < below < 36 and light == sets.filter(f"n < {below}").count() > 100
    assert lists.filter("place > 0").filter("n > 30").count() > 0
    out = ngram_join.jaccard_components(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == expected(rows)


def test_subsets_meet_whenever_sets_are_similar():
    rng = np.random.default_rng(9)
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 14)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 60, rng.integers(0, 2)).astype(np.uint64)]))
        if len(b) and ngram_join.similar(a, b):
            assert len(np.intersect1d(ngram_join._subsets(a, 30), ngram_join._subsets(b, 30)))


def test_documents_of_one_id(spark):
    t, u = " ".join(f"t{k}" for k in range(30)), " ".join(f"u{k}" for k in range(30))
    rows = [(3, t, "en", "a"), (5, t, "en", "a"), (5, u, "en", "a"), (None, t, "en", "a"), (7, None, "en", "a")]
    out = ngram_join.jaccard_components(documents(spark, rows), keys=True).collect()
    of = {(r.doc_id, r.n_shingles, r.text_key): (r.component_id, r.component_key) for r in out}
    firsts = {k: v == (k[0], k[2]) for k, v in of.items() if k[0] is not None}
    assert len(out) == 5 and sum(firsts.values()) == 3  # (3, t), (5, u) and the empty one
    assert {v[0] for k, v in of.items() if k[0] == 5} == {3, 5}


def test_prefixes_of_similar_sets_share_enough():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 80)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.92], rng.integers(0, 1 << 60, rng.integers(0, 4)).astype(np.uint64)]))
        if len(b) and ngram_join.similar(a, b):
            pa = a[: len(a) - ngram_join.least_overlap(len(a)) + ngram_join.spare(len(a))]
            pb = b[: len(b) - ngram_join.least_overlap(len(b)) + ngram_join.spare(len(b))]
            need = max(1, -(-ngram_join.least_overlap(len(a)) // 10))
            assert len(np.intersect1d(pa, pb)) >= need


def test_repeated_keys_are_told():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, 500).astype(np.uint64), rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b[:50] = a[:50]
    a = np.r_[a, a[100:110]]  # inside one block
    told = {0: set(), 1: set()}
    blocks: dict = {}
    for n, keys in enumerate((a, b)):
        parts, known = repeats.split(keys, np.arange(len(keys)), 7)
        told[n] |= set(known.tolist())
        for bucket, k, p in parts:
            blocks.setdefault(bucket, []).append((n, (k, p)))
    for members in blocks.values():
        for (n, _), found in zip(members, repeats.repeated([m for _, m in members]), strict=True):
            told[n] |= set(found.tolist())
    assert told[0] == set(range(50)) | set(range(100, 110)) | set(range(500, 510))
    assert told[1] == set(range(50))


def test_connected_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 103), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}


def linked_pairs(rows):
    sets = []
    for i, t, *_ in rows:
        w = folded(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    alike = lambda x, y: bool(x & y) and 5 * len(x & y) >= 4 * len(x | y)
    known = [(i, s) for i, s in sets if i is not None and s]
    counts = [0 if i is None or not s else sum(alike(s, y) for _, y in known) - 1 for i, s in sets]
    least = {}
    for i, s in known:
        least[s] = min(i, least.get(s, i))
    classes = sorted((i, s) for s, i in least.items())
    pairs = sorted((i, j) for n, (i, x) in enumerate(classes) for j, y in classes[n + 1 :] if alike(x, y))
    return sorted(((i, n) for (i, _), n in zip(sets, counts, strict=True)), key=str), pairs


def test_every_link_is_counted_and_paired(spark, monkeypatch):
    rows = texts()
    rows += [(900 + k, " ".join(f"v{j}" if j != 7 * k else f"own{k}" for j in range(120)), "en", "a") for k in range(9)]  # links beside the pivot's
    counts, pairs = linked_pairs(rows)
    assert sum(a >= 900 for a, _ in pairs) > 8  # more than a star around one pivot
    for block in (1024, 3):  # whole components, and components of many blocks
        monkeypatch.setattr(ngram_join, "_BLOCK_SETS", block)
        out = ngram_join.jaccard_components(documents(spark, rows), links=True).collect()
        assert sorted(((r.doc_id, r.n_links) for r in out), key=str) == counts
        assert sorted((r.a, r.b) for r in ngram_join.jaccard_links(documents(spark, rows)).collect()) == pairs


def test_counted_links_equal_sql(spark):
    assert difference(spark, connection(), catalog.op1_ngram_join, catalog.oracle_sql()["op1_ngram_join"]) == ""


def test_two_levels_tell_the_same(spark, monkeypatch):
    rng = np.random.default_rng(10)
    blocks = [rng.integers(0, 1 << 63, 3000).astype(np.uint64) for _ in range(9)]
    blocks[4][:200] = blocks[1][:200]
    blocks[7][:50] = blocks[1][:50]
    blocks[8][10:20] = blocks[8][:10]

    def told(fan):
        monkeypatch.setattr(repeats, "FAN", fan)
        cells, found = [], {}
        for n, keys in enumerate(blocks):
            parts, known = repeats.split(keys, np.arange(len(keys)), 64)
            assert len(parts) <= fan
            cells += [(b, n, bytearray(k), bytearray(p)) for b, k, p in parts]
            found[n] = set(known.tolist())
        frame = spark.createDataFrame(cells, "bucket int, chunk long, keys binary, payload binary")
        for r in repeats.tell(frame, 64, len(blocks)).collect():
            found[r.chunk] |= set(repeats.unpack(bytes(r.payload), np.uint32).tolist())
        return found

    one, two = told(1024), told(4)
    assert one == two == {**{n: set() for n in range(9)}, 1: set(range(200)), 4: set(range(200)), 7: set(range(50)), 8: set(range(20))}


def test_cells_stay_bounded_at_10_tb():
    buckets = repeats.buckets_for(10 << 40)
    cells, _ = repeats.split(np.random.default_rng(0).integers(0, 1 << 63, 200_000).astype(np.uint64), np.arange(200_000), buckets)
    assert buckets > 400_000 and len(cells) <= repeats.FAN and -(-buckets // repeats.FAN) <= repeats.FAN
