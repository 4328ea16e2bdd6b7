"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts by language over a bounded sample of the labelled rows (all rows of
small languages); the smoothed log-probability matrix is broadcast and each batch of texts is
scored as sparse rows in numpy.

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is every text when
nothing was learned; ties go to the language first in code-point order; rows without a label
are not learned from; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.common import BROADCAST_ROWS, mix64, text_chunks

UNKNOWN = "und"
#: Bytes of text whose n-grams a worker holds at once; they take over a hundred times as many.
CHUNK_BYTES = 1 << 18
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    #: Longest n-gram, buckets as a power of two, added count.
    longest: int = 3
    bits: int = 15
    smoothing: float = 0.5
    #: Bound of the training sample: labelled rows a language, and languages (the most frequent).
    rows_per_language: int = 3000
    languages: int = 256
    #: n-grams of evidence at which the posterior stops sharpening.
    evidence: int = 60


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def features(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``texts`` and the text that each is from, in order of text."""
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    letter = _letters()[points]
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]  # one blank at most on either side of a word
    points, owner = np.where(letter, points, 32)[keep].astype(np.uint64), owner[keep]
    buckets, owners = [], []
    gram = np.zeros(len(points), dtype=np.uint64)
    mask = _U((1 << s.bits) - 1)
    with np.errstate(over="ignore"):
        for n in range(1, s.longest + 1):
            m = len(points) - n + 1
            if m <= 0:
                break
            gram = gram[:m] * _U(0x110001) + points[n - 1 :]
            whole = owner[:m] == owner[n - 1 :]
            if n == 1:
                whole &= points != 32
            buckets.append((mix64(gram[whole] + _U(n << 56)) & mask).astype(np.int32))
            owners.append(owner[:m][whole])
    if not buckets:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    b, o = np.concatenate(buckets), np.concatenate(owners)
    by = np.argsort(o, kind="stable")
    return b[by], o[by]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # languages x buckets
    log_prior: np.ndarray


def train(docs: DataFrame, usable: Column, *, text_col: str = "text", label_col: str = "lang", sample_by: Column, settings: Settings = Settings()) -> Model:
    """Learn from the rows of ``docs`` where ``usable``; ``sample_by``: what the sample is dealt by."""
    labelled = docs.filter(usable & F.col(label_col).isNotNull())
    sizes = labelled.groupBy(F.col(label_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(settings.languages).collect()
    names = tuple(sorted(r["lang"] for r in sizes))
    n_buckets = 1 << settings.bits
    if not names:
        return Model((), np.zeros((0, n_buckets), np.float32), np.zeros(0))
    grain = 1 << 20
    share = {r["lang"]: min(grain, -(-grain * settings.rows_per_language // r["n"])) for r in sizes}
    rates = docs.sparkSession.createDataFrame([(k, i, share[k]) for i, k in enumerate(names)], "_lang string, _at int, _share int")
    sample = (
        labelled.select(F.col(label_col).alias("_l"), F.col(text_col).alias("t"), F.pmod(F.xxhash64(F.lit("langid"), sample_by), F.lit(grain)).alias("_u"))
        .join(F.broadcast(rates), F.col("_l") == F.col("_lang"))
        .filter(F.col("_u") < F.col("_share"))
        .select("_at", "t")
    )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), n_buckets), dtype=np.int64)
        for batch in batches:
            for lo, hi in text_chunks(batch, "t", CHUNK_BYTES):
                b, o = features([t or "" for t in batch.column("t").slice(lo, hi - lo).to_pylist()], settings)
                lang = batch.column("_at").slice(lo, hi - lo).to_numpy(zero_copy_only=False)[o]
                total += np.bincount(lang.astype(np.int64) * n_buckets + b, minlength=total.size).reshape(total.shape)
        at, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[at, bucket])], ["at", "bucket", "n"])

    # languages x buckets numbers at most come back
    counts = np.zeros((len(names), n_buckets))
    sums = sample.mapInArrow(count, "at int, bucket int, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[sums["at"].to_numpy(), sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    smooth = counts + settings.smoothing
    prior = np.zeros(len(names))  # languages are equally likely before the text is seen
    return Model(names, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32), prior)


def score(texts: list[str], model: Model, s: Settings) -> tuple[list[str], list[float]]:
    b, o = features(texts, s)
    n = np.bincount(o, minlength=len(texts))
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    has = np.flatnonzero(n)
    if len(has) == 0 or not model.languages:
        return labels, scores
    heads = np.r_[0, np.cumsum(n[has])[:-1]]
    like = np.stack([np.add.reduceat(row[b], heads, dtype=np.float64) for row in model.log_prob])
    like = like * np.minimum(1.0, s.evidence / n[has]) + model.log_prior[:, None]
    like -= like.max(axis=0)
    post = np.exp(like)
    post /= post.sum(axis=0)
    best = post.argmax(axis=0)
    for k, at in enumerate(has.tolist()):
        labels[at], scores[at] = model.languages[best[k]], float(post[best[k], k])
    return labels, scores


def identify(docs: DataFrame, model: Model, *, columns: list[str], text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``columns`` of ``docs`` plus ``lang_pred`` and ``score``, which replace columns so named."""
    columns = [c for c in columns if c not in ("lang_pred", "score")]
    if model.log_prob.size > 64 * BROADCAST_ROWS:
        raise ValueError("the model is larger than its bound")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_chunks(batch, "__t", CHUNK_BYTES):
                part = batch.slice(lo, hi - lo)
                lang, p = score([t or "" for t in part.column("__t").to_pylist()], shared.value, settings)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(lang, pa.string()), pa.array(p, pa.float64())], schema.fieldNames())

    return docs.select(*columns, docs[text_col].alias("__t")).mapInArrow(run, schema)
