import math
import random
import re

from pyspark.sql import functions as F

from sensorloom.llm import toxicity
from tests.llm.data import documents, empty

S = toxicity.Settings(least_evidence=6.0)


def labelled(seed=3, n=400):
    r = random.Random(seed)
    rows, marks = [], []
    for k in range(n):
        toxic = r.random() < 0.25
        words = [r.choice(["alpha", "beta", "gamma", "delta", "thing", "stone", "river"]) for _ in range(r.randrange(8, 60))]
        for _ in range(r.randrange(1, 4) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["moron", "scum", "trash", "gromling", "gromster"]))
        rows.append((k, " ".join(w + ("." if r.random() < 0.1 else "") for w in words), "en", "a"))
        marks.append((k, int(toxic)))
    return rows, marks


def grammar(**weights):
    return toxicity.Grammar({"scum$": 4.0, "grom": 3.0}, toxicity.Settings(**weights), [0.0] * 7)


def clause(g, text):
    return g.clause([g.readings(w) for w in toxicity._TOKEN(text)])


def test_clause_transducer():
    g = grammar()
    plain = clause(g, "the scum sat")
    assert plain == 4.0
    assert clause(g, "you scum") > clause(g, "she scum") > plain > clause(g, "not really scum") > 0
    assert clause(g, "they said scum") < clause(g, "they scum")
    assert clause(g, 'they " scum "') < clause(g, "they scum")
    assert clause(g, "no one here walked by scum") == plain  # beyond the negation's reach
    assert clause(g, "kill you") == S.threat[2] and clause(g, "killing them") == S.threat[1] and clause(g, "kill time") == 0
    assert clause(g, "never kill you") < S.threat[2]
    assert clause(g, "gromster") == 3.0 and clause(g, "alpha beta") == 0


def test_contracted_negations():
    g = grammar()
    for text in ("isn't scum", "don’t say scum", "wasn't really scum"):
        assert clause(g, text) < clause(g, "scum")
    assert toxicity._TOKEN("you're don't l'idiot can’t \"so\"") == ["you", "re", "don't", "l", "idiot", "can’t", '"', "so", '"']


def paths(readings, t):
    """Weights of all paths, one by one."""
    every = [(t.start, 0.0)]
    for word in readings:
        every = [(to, total + w + cost) for state, total in every for symbol, w in word for to, cost in t.arcs[state][symbol]]
    return [total + t.ends[state] for state, total in every]


def test_best_path_equals_the_best_of_all_paths():
    g, r = grammar(), random.Random(5)
    words = ["scum", "gromling", "not", "never", "said", '"', "you", "them", "kill", "killed", "don't", "thing", "stone"]
    most = 0
    for _ in range(300):
        readings = [g.readings(r.choice(words)) for _ in range(r.randrange(1, 9))]
        every = paths(readings, g.clauses)
        most = max(most, len(every))
        assert math.isclose(toxicity.compose(readings, g.clauses), max(every), abs_tol=1e-9)
        assert math.isclose(g.clause(readings), max(0.0, max(every)), abs_tol=1e-9)
    assert most > 100  # many readings of one clause


def test_several_states_are_alive():
    t, alive = grammar().clauses, []
    best = {t.start}
    for word in [grammar().readings(w) for w in ("you", "never", "said", "scum", "kill", "them")]:
        best = {to for state in best for symbol, _ in word for to, _ in t.arcs[state][symbol]}
        alive.append(len(best))
    assert max(alive) > 4


def test_plain_words_beyond_the_reach_change_nothing():
    g = grammar()
    for n in (3, 4, 9):
        readings = [g.readings(w) for w in ["not", *["thing"] * n, "scum"]]
        assert g.clause(readings) == toxicity.compose(readings, g.clauses) == 4.0


def test_clauses_end_at_stops():
    g = grammar()
    assert g.features("not. scum")[1] > g.features("not scum")[1]
    assert g.features("") == g.features("alpha") == (0.0,) * 6


def score_by_hand(g, text):
    """The score from its statement: clauses, all their paths, six sums, the link."""
    found, words = [], 0
    for part in re.split(r"[.!?;:\n|]", (text or "").lower()):
        tokens = toxicity._TOKEN(part)
        words += sum(t not in toxicity._QUOTES for t in tokens)
        best = max(paths([g.readings(t) for t in tokens], g.clauses))
        found += [best] if best > 0 else []
    x = [math.log1p(sum(found)), max(found, default=0), math.log1p(len(found)), sum(found) / (5 + words), math.log1p(words) if found else 0, sum(sorted(found)[-3:])]
    return 1 / (1 + math.exp(-(g.link[0] + sum(a * b for a, b in zip(g.link[1:], x)))))


def test_scores_equal_those_by_hand(spark):
    r = random.Random(8)
    words = ["scum", "gromling", "not", "said", "you", "kill", "thing", "stone", "river", "isn't"]
    rows = [(k, ". ".join(" ".join(r.choice(words) for _ in range(r.randrange(0, 7))) for _ in range(r.randrange(0, 5))), "en", "a") for k in range(60)]
    g = grammar()
    g.link = [-1.0, 0.5, 0.3, 0.2, 1.0, -0.1, 0.05]
    for row in toxicity.score_toxicity(documents(spark, rows), g).collect():
        assert math.isclose(row.score, score_by_hand(g, rows[row.doc_id][1]), abs_tol=1e-9)


def test_conflicting_labels_are_not_learned_from(spark):
    rows, marks = labelled()
    docs = documents(spark, rows)
    train = lambda m: toxicity.train(docs, spark.createDataFrame(m, "doc_id long, toxic int"), F.lit(True), settings=S)
    bad = [(k, 1 - y) for k, y in marks[:50]]
    a, b = train(marks + bad), train(marks[50:])
    assert a.insults == b.insults and a.link == b.link


def test_held_out_labels(spark):
    rows, marks = labelled()
    docs, labels = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    g = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0, settings=S)
    assert any(p.startswith("gro") for p in g.insults)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, g).collect()}
    held = [(got[k], y) for k, y in marks if k % 5 == 0]
    assert sum((p >= 0.5) == (y == 1) for p, y in held) >= 0.95 * len(held)


def test_awkward_rows_and_labels(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (999, 1), (1, 1)], "doc_id long, toxic int")
    for lab in (labels, labels.filter("toxic = 1"), labels.limit(0)):
        out = toxicity.score_toxicity(docs, toxicity.train(docs, lab, F.lit(True))).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_toxicity(empty(spark), grammar()).collect() == []
