"""Toxicity: a weighted finite-state grammar over clauses, fitted to labels.

Two weighted transducers are composed in the (max, +) semiring.  The lexical one gives a word its
readings: an insult of some weight, by word and stem patterns learned from labelled rows, a threat,
a target, a negation, a report, a quotation mark, and for ambiguous words the plain reading too.  The
clause one goes through states (how near a target was, threat, insult, speech, words that a negation
still reaches); negations and reports have an arc that opens their scope and a dearer one that does
not.  So a clause has many paths, and its weight is that of the best one: an insult under a
negation counts if that reading beats taking the word plainly.  A logistic link over a text's
clause weights, fitted to the same rows, gives the score.

Edge cases: null and empty texts have no clause and get the score of a text without matches; rows
without a label are not learned from, nor is a document that has both labels; without any label of
either kind the score is the prior or 0.5; repeated rows give repeated results; a very long text is
read clause by clause, whole; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.common import text_chunks

PLAIN, INSULT, THREAT, YOU, THEY, NEGATION, REPORT, QUOTE = range(8)

#: Closed-class words of the languages covered, by symbol.
WORDS = {
    YOU: "you your yours yourself yourselves u ur ya du dich dir dein deine deinen deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tuyo tus",
    THEY: "he him his she her hers they them their these those everyone somebody someone er ihm ihn sein seine jene alle il elle lui ils elles leur leurs eux ceux él ella ellos ellas esos esas",
    NEGATION: "not no never neither nor none nobody nothing hardly without cannot nicht kein keine keinen keiner keinem niemals nie niemand nichts ohne ne pas jamais aucun aucune sans rien personne nunca jamás ningún ninguna ninguno sin nadie nada tampoco",
    REPORT: "said says say saying told tells wrote writes written quoted quotes quote reported reports claimed claims called sagte sagt sagten schrieb schreibt zitierte zitiert meinte behauptete nannte dit disait écrit écrivait cité citait appelé déclaré dijo dice decía escribió escribe citó llamó",
}
#: Stems of threats; what follows a stem is an ending.
THREATS = "kill murder hurt destroy punch shoot stab strangl beat burn töt ermord schlag vernicht erschieß erschiess verletz tuer tuerai frapp détrui brûl étrangl mata golpe destru quema apuñal"
#: Longest ending that a threat's stem may have.
_ENDING = 4

#: A word keeps the apostrophe of a contracted negation (don't, isn't); other apostrophes part words.
_TOKEN = re.compile(r"[^\W_]+(?:(?<=n)['’]t\b)?|[.!?;:\n|]|[\"“”«»„]").findall
_STOPS = frozenset(".!?;:\n|")
_QUOTES = frozenset("\"“”«»„")
_LISTS = {s: frozenset(ws.split()) for s, ws in WORDS.items()}
_THREATS = tuple(THREATS.split())


@dataclass(frozen=True)
class Settings:
    #: Bound of the training sample, rows of each label; it bounds the patterns that are learned.
    rows_per_label: int = 8000
    #: Stems are prefixes of these lengths; a pattern needs so many toxic texts and so much evidence.
    stems: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    least_texts: int = 4
    least_log_odds: float = 1.2
    least_evidence: float = 12.0
    #: Words that a negation reaches.
    reach: int = 3
    #: Weights of the clause transducer's arcs: an insult in a scope, and a scope that is not opened.
    negated: float = -2.0
    reported: float = -1.5
    skip_negation: float = -1.4
    skip_report: float = -1.0
    #: Weights at the end of a clause with an insult or threat, by target.
    targeted: tuple[float, float, float] = (0.0, 0.2, 0.5)
    threat: tuple[float, float, float] = (0.0, 1.2, 2.0)


@dataclass
class Transducer:
    """States with weighted arcs by symbol; ``ends`` are final weights."""

    start: tuple
    arcs: dict[tuple, dict[int, list[tuple[tuple, float]]]]
    ends: dict[tuple, float]


def clause_transducer(s: Settings) -> Transducer:
    """States are (target 0 to 2, threat, insult, speech, words left of a negation)."""
    arcs: dict[tuple, dict[int, list[tuple[tuple, float]]]] = {}
    ends = {}
    for state in product(range(3), (0, 1), (0, 1), (0, 1), range(s.reach + 1)):
        target, threat, insult, speech, left = state
        after = max(0, left - 1)
        on = lambda **new: tuple({"target": target, "threat": threat, "insult": insult, "speech": speech, "left": after, **new}.values())  # noqa: B023, E731
        scope = (s.negated if left else 0.0) + (s.reported if speech else 0.0)
        arcs[state] = {
            PLAIN: [(on(), 0.0)],
            INSULT: [(on(insult=1), scope)],
            THREAT: [(on() if left else on(threat=1), 0.0)],
            YOU: [(on(target=2), 0.0)],
            THEY: [(on(target=max(target, 1)), 0.0)],
            NEGATION: [(on(left=s.reach), 0.0), (on(), s.skip_negation)],
            REPORT: [(on(speech=1), 0.0), (on(), s.skip_report)],
            QUOTE: [(on(speech=1 - speech), 0.0), (on(), s.skip_report)],
        }
        ends[state] = (s.targeted[target] if insult else 0.0) + (s.threat[target] + (s.reported if speech else 0.0) if threat and target else 0.0)
    return Transducer((0, 0, 0, 0, 0), arcs, ends)


def compose(readings: list[tuple[tuple[int, float], ...]], t: Transducer) -> float:
    """The best path's weight through a clause's words: their readings composed with ``t``.

    Lazily: only states that some path reaches are kept, each with its best weight.
    """
    best = {t.start: 0.0}
    for word in readings:
        reached: dict[tuple, float] = {}
        for state, total in best.items():
            arcs = t.arcs[state]
            for symbol, weight in word:
                for to, cost in arcs[symbol]:
                    now = total + weight + cost
                    if now > reached.get(to, -math.inf):
                        reached[to] = now
        best = reached
    return max(total + t.ends[state] for state, total in best.items())


_ONLY_PLAIN = ((PLAIN, 0.0),)


@dataclass
class Grammar:
    insults: dict[str, float]  # whole words as "word$", stems as they are
    settings: Settings
    link: list[float] = field(default_factory=list)
    memo: dict[str, tuple[tuple[int, float], ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.clauses = clause_transducer(self.settings)

    def readings(self, word: str) -> tuple[tuple[int, float], ...]:
        """The lexical transducer's arcs for a word: symbols with weights.

        Of several insult patterns the heaviest stays, as no best path takes another.  Negations,
        reports and marks have no plain arc here: the clause transducer has theirs.
        """
        found = self.memo.get(word)
        if found is None:
            if word in _QUOTES:
                found = ((QUOTE, 0.0),)
            elif word in _LISTS[NEGATION] or word.endswith(("n't", "n’t")):
                found = ((NEGATION, 0.0),)
            elif word in _LISTS[REPORT]:
                found = ((REPORT, 0.0),)
            else:
                weights = [self.insults[p] for p in (word + "$", *(word[:n] for n in self.settings.stems if n <= len(word))) if p in self.insults]
                arcs = [(INSULT, max(weights))] if weights else []
                arcs += [(symbol, 0.0) for symbol in (YOU, THEY) if word in _LISTS[symbol]]
                arcs += [(THREAT, 0.0)] if any(word.startswith(x) and len(word) <= len(x) + _ENDING for x in _THREATS) else []
                found = (*arcs, (PLAIN, 0.0)) if arcs else _ONLY_PLAIN
            if len(self.memo) > 400_000:
                self.memo.clear()
            if len(word) <= 48:
                self.memo[word] = found
        return found

    def clause(self, words: list[tuple[tuple[int, float], ...]]) -> float:
        """The best path's weight, 0 if every word is best taken plainly.

        Plain words do nothing but use up a negation's reach: of more than that in a row, the rest
        change no state and are left out.
        """
        kept, plain = [], 0
        for w in words:
            plain = plain + 1 if w is _ONLY_PLAIN else 0
            if plain <= self.settings.reach:
                kept.append(w)
        return max(0.0, compose(kept, self.clauses))

    def features(self, text: str) -> tuple[float, ...]:
        """Sum and largest of the clause weights, matched clauses, and each against the length."""
        words, weights, clause, live = 0, [], [], False
        readings = self.readings
        for token in _TOKEN(text.lower()):
            if token in _STOPS:
                if live:
                    weights.append(self.clause(clause))
                clause, live = [], False
                continue
            words += token not in _QUOTES
            r = readings(token)
            clause.append(r)
            live = live or r[0][0] in (INSULT, THREAT) or (len(r) > 1 and r[-2][0] == THREAT)
        if live:
            weights.append(self.clause(clause))
        weights = [w for w in weights if w > 0]
        total, length = sum(weights), math.log1p(words)
        top = sorted(weights, reverse=True)[:3]
        return (math.log1p(total), max(weights, default=0.0), math.log1p(len(weights)), total / (5 + words), length if weights else 0.0, sum(top))

    def score(self, text: str) -> float:
        x = self.features(text)
        z = self.link[0] + sum(a * b for a, b in zip(self.link[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _patterns(text: str, s: Settings) -> set[str]:
    words = {w for w in _TOKEN(text.lower()) if w not in _STOPS and w not in _QUOTES}
    return {w + "$" for w in words} | {w[:n] for w in words for n in s.stems if n <= len(w)}


def _select(rows: list, s: Settings) -> dict[str, float]:
    """Patterns whose texts are toxic far more often, without those that a stem already explains."""
    kept: dict[str, float] = {}
    for p, odds in sorted(((r["p"], r["odds"]) for r in rows), key=lambda x: (len(x[0]), x[0])):
        body = p.removesuffix("$")
        by_stem = max((kept[body[:n]] for n in s.stems if n <= len(body) and body[:n] in kept and body[:n] != p), default=-math.inf)
        if odds > by_stem + 0.5:
            kept[p] = odds
    return kept


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Logistic regression by Newton's method, with both labels weighing alike."""
    x = np.c_[np.ones(len(x)), x]
    w, beta = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y), np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.diag([1e-6] + [1e-3] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * len(y) * np.r_[0, np.full(x.shape[1] - 1, 1e-3)] * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def train(docs: DataFrame, labels: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> Grammar:
    """Learn from the rows of ``docs`` with a label where ``usable`` (over ``id_col``)."""
    s = settings
    given = labels.filter(usable & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).filter("__id is not null")
    # one label a document; those with both are not learned from
    marked = given.groupBy("__id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Grammar({}, s, [0.0 if not sizes else (3.0 if 1 in sizes else -3.0), *[0.0] * 6])
    grain = 1 << 20
    share = F.when(F.col("y") == 1, min(grain, grain * s.rows_per_label // sizes[1])).otherwise(min(grain, grain * s.rows_per_label // sizes[0]))
    chosen = marked.filter(F.pmod(F.xxhash64(F.lit("toxic"), "__id"), F.lit(grain)) < share)
    # about 2 * rows_per_label rows: a bounded broadcast
    sample = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("t")).join(F.broadcast(chosen), "__id").select("t", "y")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_chunks(batch, "t", limit=8 << 20):
                toxic, clean = Counter(), Counter()
                for text, y in zip(batch.column("t").slice(lo, hi - lo).to_pylist(), batch.column("y").slice(lo, hi - lo).to_pylist(), strict=True):
                    (toxic if y else clean).update(_patterns(text or "", s))
                keys = list(toxic.keys() | clean.keys())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["p", "n1", "n0"])

    n1, n0 = min(sizes[1], s.rows_per_label), min(sizes[0], s.rows_per_label)
    sums = sample.mapInArrow(count, "p string, n1 long, n0 long").groupBy("p").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    p1, p0 = (F.col("n1") + 0.5) / (n1 + 1.0), (F.col("n0") + 0.5) / (n0 + 1.0)
    pooled = (F.col("n1") + F.col("n0") + 1.0) / (n1 + n0 + 2.0)
    evidence = (p1 - p0) / F.sqrt(pooled * (1 - F.least(pooled, F.lit(0.999))) * (1.0 / n1 + 1.0 / n0))
    rows = (
        sums.filter(F.col("n1") >= s.least_texts)
        .select("p", F.log(p1 / p0).alias("odds"), (evidence * evidence).alias("evidence"))
        .filter((F.col("odds") >= s.least_log_odds) & (F.col("evidence") >= s.least_evidence))
        .select("p", "odds").collect()  # patterns of a bounded sample
    )
    grammar = Grammar(_select(rows, s), s)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [grammar.features(t or "") for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([list(v) for v in x], pa.list_(pa.float64()))], ["y", "x"])

    table = sample.mapInArrow(measure, "y int, x array<double>").toArrow()  # seven numbers a sampled row
    if table.num_rows:
        x, y = np.array(table["x"].to_pylist()), np.array(table["y"].to_pylist())
        order = np.lexsort((*x.T, y))  # the same sums whatever order the rows came in
        grammar.link = _fit(x[order], y[order])
    else:
        grammar.link = [0.0] * 7
    grammar.memo = {}
    return grammar


def score_toxicity(docs: DataFrame, grammar: Grammar, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_chunks(batch, "t"):
                scores = [shared.value.score(t or "") for t in batch.column("t").slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("i").slice(lo, hi - lo), pa.array(scores, pa.float64())], schema.fieldNames())

    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, schema)
