import collections
import zlib

import numpy as np
from pyspark.sql import functions as F

from sensorloom.llm import sharding
from tests.llm.data import documents, empty, texts


def test_rows_law_and_slots(spark):
    docs = documents(spark)
    out = sharding.shuffle_into_shards(docs, 24, bucket_bytes=20_000)
    assert set(out.columns) == set(docs.columns) | {"slot"}  # shard replaces the column of that name
    rows = out.collect()
    assert len(rows) == len(texts())
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(24))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_reruns_and_partitions_do_not_matter(spark):
    docs = documents(spark)
    place = lambda d: sorted((str(r.doc_id), str(r.text), r.shard, r.slot) for r in sharding.shuffle_into_shards(d, 5).collect())
    assert place(docs) == place(docs.repartition(7))


def test_digest(spark):
    rows = [(i, t) for i, t, *_ in texts()]
    out = sharding.shard_digest(sharding.shuffle_into_shards(documents(spark), 24)).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == want
    assert {r.law for r in out} == {"rows"}


def test_written_shards_hold_all_rows(spark, tmp_path):
    sharding.write_shards(sharding.shuffle_into_shards(documents(spark), 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(texts())


def test_few_rows_and_none(spark):
    rows = sharding.shuffle_into_shards(documents(spark, texts()[:3]), 24).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.shuffle_into_shards(empty(spark), 24).collect() == []


def place_of(rows, shards, seed, bucket_bytes, spark):
    """The shuffle by hand, from Spark's hash: buckets in order, each shuffled in order of its keys."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    seen, keyed = collections.Counter(), []
    for r in frame.selectExpr("doc_id", "text", f"xxhash64({seed}, doc_id, text) AS k").collect():
        seen[r.k] += 1
        keyed.append((r.doc_id, r.text, r.k, seen[r.k]))
    told = spark.createDataFrame(keyed, "doc_id long, text string, k long, times long").selectExpr("doc_id", "text", "CASE WHEN times = 1 THEN k ELSE xxhash64(k, times) END AS k")
    size = sum(8 + 8 + len((t or "").encode()) for _, t in rows)
    buckets = max(1, -(-size // bucket_bytes))
    by = collections.defaultdict(list)
    for r in told.selectExpr("*", f"pmod(xxhash64({seed + 1}, k), {buckets}L) AS b").collect():
        by[r.b].append((r.k, r.doc_id, r.text))
    order = []
    for b in sorted(by):
        at = np.arange(len(by[b]))
        np.random.Generator(np.random.PCG64([seed, b])).shuffle(at)
        members = sorted(by[b], key=lambda x: x[0])
        order += [members[i] for i in at]
    base, extra = divmod(len(order), shards)
    edges = [base + (s < extra) for s in range(shards)]
    shard = [(s, j) for s, n in enumerate(edges) for j in range(n)]
    return sorted((str(i), str(t), *p) for (_, i, t), p in zip(order, shard, strict=True))


def test_placement_equals_the_shuffle_by_hand(spark):
    rows = [(k % 190, f"text {k % 190} " * (k % 7)) for k in range(240)] + [(None, None)] * 5
    got = sharding.shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string"), 7, seed=11, bucket_bytes=1500).collect()
    assert sorted((str(r.doc_id), str(r.text), r.shard, r.slot) for r in got) == place_of(rows, 7, 11, 1500, spark)


def test_copies_spread_as_strangers_do(spark):
    rows = [(k // 2, f"text {k // 2}") for k in range(4000)] + [(9999, "very often")] * 2400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shuffle_into_shards(docs, 24, bucket_bytes=4000).collect()
    where = collections.defaultdict(list)
    for r in out:
        where[r.doc_id].append(r.shard)
    hot = collections.Counter(where.pop(9999))
    assert 60 < min(hot.values()) and max(hot.values()) < 140  # 100 each by chance
    together = sum(a == b for a, b in where.values())
    assert 40 < together < 140  # 1 in 24 of 2,000 pairs


def test_columns_of_other_types_and_names(spark):
    docs = spark.sql("SELECT id AS doc_id, 'same' AS text, map('a', 1) AS m, array(id % 2) AS l, 1 AS __key, 2 AS __bucket, 3 AS __copy FROM range(50)").drop("doc_id").withColumn("doc_id", F.lit(1))
    out = sharding.shuffle_into_shards(docs, 5).collect()
    assert len(out) == 50 and all(r["__key"] == 1 and r["__bucket"] == 2 and r["__copy"] == 3 and r.m == {"a": 1} for r in out)
    assert sorted((r.shard, r.slot) for r in out) == [(s, j) for s in range(5) for j in range(10)]
