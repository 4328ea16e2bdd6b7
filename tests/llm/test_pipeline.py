"""The pipeline's rows against brute force, stage by stage on a small corpus."""

import collections
import random

import pytest

import corpus_pipeline
from sensorloom.llm import decontam
from tests.llm.data import WORD, documents
from tests.llm.test_decontam import expected as hits
from tests.llm.test_mixing import expected_targets
from tests.llm.test_ngram_join import expected as components

LONG = " ".join(f"question{k}" for k in range(40))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    vocab = {"en": [f"th{a}{b}" for a in "aeiou" for b in "nrstl"], "de": [f"sch{a}{b}" for a in "äöüei" for b in "nrztk"]}
    rows = []
    for k in range(150):
        lang = r.choice(["en", "de"])
        rows.append((k, " ".join(r.choice(vocab[lang]) for _ in range(r.randrange(20, 80))), lang, r.choice("abc")))
    for k in range(150, 170):  # near copies
        base = rows[k % 5][1].split()
        base[r.randrange(len(base))] = "changed"
        rows.append((k, " ".join(base * 3) if k % 2 else rows[k % 5][1], rows[k % 5][2], "b"))
    rows += [(k, "123 456 !!" if k % 2 else "", "en", "a") for k in range(170, 176)] + [(176, None, None, None)]
    rows += [(k, rows[k - 170][1] + " " + LONG, "en", "c") for k in range(177, 182)]  # benchmark passages
    rows += [rows[20], (None, rows[30][1] + " other words", "en", "a")]
    return rows


@pytest.fixture(scope="module")
def out(spark, corpus, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    documents(spark, corpus).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, LONG), (2, "nothing of the kind here"), (3, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    steps = {}
    docs = spark.read.parquet(str(path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, str(path))
        if name != "sharding":
            assert done.columns == docs.columns
        done.write.parquet(str(path / name))
        docs = spark.read.parquet(str(path / name))
        steps[name] = docs.collect()
    steps["run"] = corpus_pipeline.run(spark, str(path)).collect()
    return steps


def key(rows):
    return sorted((str(r[0]), str(r[1])) for r in rows)


def test_language_stage_drops_texts_without_letters(corpus, out):
    assert key(out["language_id"]) == key([r for r in corpus if any(c.isalpha() for c in r[1] or "")])


def test_one_document_of_each_group_stays(out):
    before = [tuple(r) for r in out["language_id"]]
    labels = {i: c for i, _, c in components(before)}
    keep = {c for c in labels.values() if c is not None}
    want = sorted({(str(i), t) for i, t, *_ in before if i in keep} | {(str(i), t) for i, t, *_ in before if i is None})
    assert key(out["ngram_join"]) == want


def test_benchmark_documents_go(out):
    before = [tuple(r) for r in out["ngram_join"]]
    items = [(1, LONG), (2, "nothing of the kind here"), (3, None)]
    bad = collections.Counter(i for i, *_, dirty in hits(before, items) if dirty)
    assert bad and key(out["decontamination"]) == key([r for r in before if not bad[str(r[0])]])
    assert decontam.WINDOW == 13


def test_sources_meet_their_targets(out):
    size = lambda r: len(WORD.findall(r[1] or ""))
    before, after = out["decontamination"], out["mixing"]
    sizes = collections.Counter()
    for r in before:
        sizes[r.source] += size(r)
    targets = expected_targets(dict(sizes))
    taken = collections.Counter()
    for r in after:
        taken[r.source] += size(r)
    assert all(abs(taken[s] - t) <= 0.02 * t + 5 for s, t in targets.items())
    times = collections.Counter(key(after))
    assert set(times) <= set(key(before)) and max(times.values()) <= 2


def test_shards_hold_all_rows(out):
    assert key(out["sharding"]) == key(out["mixing"]) and key(out["run"]) == key(out["sharding"])
    slots = collections.defaultdict(list)
    for r in out["run"]:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def kept(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, size long, shard long"):
    return sorted(map(tuple, corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, schema), "").collect()), key=str)


def test_other_texts_of_an_id_stay(spark):
    t, u, v = (" ".join(f"{c}{k}" for k in range(30)) for c in "tuv")
    row = lambda i, text, n=1: (i, text, "en", "a", n, 1000, 7)
    rows = [row(3, t), row(5, t), row(5, u), row(5, u), row(None, t), row(None, t), row(6, None), row(6, ""), row(6, ""), row(8, v, 2), row(8, v, 1)]
    want = [row(3, t), row(5, u), row(None, t), row(None, t), row(6, None), row(6, ""), row(6, ""), row(8, v, 1)]
    assert kept(spark, rows) == sorted(want, key=str)
    assert kept(spark, rows[:0] or []) == []


def test_no_documents_and_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, copies string, lang_pred string, score string, n_hit string, row string, slot string, __id string, component_id string"
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(k, f"{text} own{k} " * 3 if k % 2 else " ".join(f"x{k}y{j}" for j in range(50)), "en", "a", 1, *["mine"] * 10) for k in range(40)]
    spark.createDataFrame([(1, LONG)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for n, some in enumerate((rows, [])):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "sharding" or out.columns == docs.columns
            assert all(r["size"] == r.target == r.copies == r.score == r.component_id == "mine" for r in out.collect())
            assert bool(some) == (not out.isEmpty())
            out.write.parquet(str(tmp_path / f"{name}-{n}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{n}"))
