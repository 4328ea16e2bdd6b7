from pyspark.sql import functions as F

from sensorloom.llm import langid
from tests.llm.data import documents, empty, texts


def run(spark, docs):
    model = langid.train(docs, F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)), sample_by=F.col("doc_id"))
    return model, langid.identify(docs, model, columns=["doc_id", "text", "lang"]).collect()


def test_languages_are_told(spark):
    model, got = run(spark, documents(spark))
    assert model.languages == ("de", "en")
    clear = [r for r in got if r.lang in ("de", "en") and r.text and len(r.text) > 60 and ("th" in r.text) != ("sch" in r.text)]
    assert sum(r.lang_pred == r.lang for r in clear) >= 0.95 * len(clear)
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_without_letters(spark):
    _, got = run(spark, documents(spark))
    bare = [r for r in got if not any(c.isalpha() for c in r.text or "")]
    assert len(bare) >= 4 and all((r.lang_pred, r.score) == ("und", 0.0) for r in bare)
    assert all(r.lang_pred != "und" for r in got if any(c.isalpha() for c in r.text or ""))


def test_nothing_learned_and_empty(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    model, got = run(spark, docs)
    assert model.languages == () and {r.lang_pred for r in got} == {"und"}
    assert run(spark, empty(spark))[1] == []


def test_counts_equal_a_plain_count():
    s = langid.Settings(bits=10, longest=2)
    b, o = langid.features(["Ab, a!", "", "ß"], s)
    want = {0: [" a", "ab", "b ", "  ", " a", "a ", "a", "b", "a"], 2: [" ß", "ß ", "ß"]}
    assert {k: int((o == k).sum()) for k in (0, 1, 2)} == {0: len(want[0]), 1: 0, 2: len(want[2])}
    again, _ = langid.features(["AB--a"], s)
    assert sorted(b[o == 0]) == sorted(again)


def test_reruns_agree(spark):
    a, b = (run(spark, documents(spark).repartition(n))[1] for n in (2, 5))
    key = lambda rows: sorted((str(r.doc_id), str(r.text)[:30], r.lang_pred, round(r.score, 9)) for r in rows)
    assert key(a) == key(b)
