"""Sharding: a two-pass external shuffle into equal shards.

Pass one scatters records into memory-sized buckets by a seeded hash; pass two shuffles each
bucket (Fisher-Yates over its records in order of their keys, seeded by bucket).  Buckets in order, each in its shuffled
order, are one random order of all records; shards are equal consecutive runs of it, so that
the ``rows`` law holds: shard sizes differ by one at most.

The scatter key covers all columns and the number of a record among records equal to it, so copies
spread as strangers do, and neither the order nor the partitions of the input matter.  Copies are
counted before they are shuffled: a record repeated very often is one row until it is dealt.

Edge cases: a null text is stored as null and counts as empty; null and repeated ids spread as any
others; a very long text is one record of its bucket; an empty table gives an empty result; extra
columns travel along, and columns whose names this operator adds (``shard``, ``slot``) replace any
of the same name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.common import materialise

LAW = "rows"
#: Buckets whose counts are added up by one task.
_SPAN = 4096


def record_size(text_col: str = "text"):
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8


def _free(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _atomic(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.BinaryType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _plain(field: T.StructField) -> Column:
    """A column as something that can be hashed and measured."""
    c = F.col(f"`{field.name}`")
    return c if _atomic(field) else F.to_json(F.struct(c))


def _bytes(field: T.StructField) -> Column:
    c = _plain(field)
    if isinstance(field.dataType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.lit(8)
    return F.coalesce(F.octet_length(c), F.lit(0)) + 8


def _numbered(docs: DataFrame, key: Column, name: str) -> DataFrame:
    """``docs`` with a key for each record: equal records are counted, then dealt one by one."""
    hashed = docs.withColumn(name, key)
    if hashed.groupBy(name).count().filter("count > 1").isEmpty():
        return hashed
    times = _free("__times", docs.columns)
    own = [F.col(f"`{c}`") for c in docs.columns]
    told = {f.name: _free(f"__as_text_{i}", docs.columns) for i, f in enumerate(docs.schema.fields) if not _atomic(f)}
    by = [_plain(f).alias(told.get(f.name, f.name)) for f in docs.schema.fields]
    counted = hashed.groupBy(name, *by).agg(F.count(F.lit(1)).alias(times), *[F.first(f"`{c}`").alias(c) for c in told])
    # a table: the buckets' counts read two of its columns
    counted = materialise(counted.select(*own, name, times), "shard-records")
    dealt = counted.select(*own, name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(times))
    # the first keeps the key that it would have without copies
    return dealt.select(*own, F.when(F.col(times) == 1, F.col(name)).otherwise(F.xxhash64(name, times)).alias(name))


def _starts(counts: DataFrame) -> DataFrame:
    """``bucket, n, first``: records of each bucket and in all before it.

    Sums run within spans of buckets and then over the spans, so no task holds all buckets.
    """
    spans = counts.withColumn("span", F.floor(F.col("bucket") / _SPAN))
    totals = spans.groupBy("span").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("span", before.alias("base"))  # one row for _SPAN buckets
    within = F.coalesce(F.sum("n").over(Window.partitionBy("span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spans.withColumn("within", within).join(bases, "span").select("bucket", "n", (F.col("base") + F.col("within")).alias("first"))


def _places(seed: int):
    """(bucket, places): where each of a bucket's records goes, by their order in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n, first in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "first")), strict=True):
                order = np.arange(n)
                np.random.Generator(np.random.PCG64([seed, b])).shuffle(order)  # Fisher-Yates
                place = np.empty(n, np.int64)
                place[order] = first + np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([place], pa.list_(pa.int64()))], ["bucket", "places"])

    return run


def shuffle_into_shards(docs: DataFrame, shards: int = 24, *, seed: int = 20_240_917, bucket_bytes: int = 4 << 20) -> DataFrame:
    """All columns of ``docs`` plus ``shard int`` and ``slot long``.

    ``bucket_bytes``: bytes of whole records that one bucket holds on average.
    """
    docs = docs.drop("shard", "slot")
    key, bucket, no, of, places, at = (_free(n, docs.columns) for n in ("__key", "__bucket", "__no", "__of", "__places", "__at"))
    size = sum((_bytes(f) for f in docs.schema.fields), F.lit(0)).cast("long")
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    rows, buckets = total["n"], max(1, -(-(total["b"] or 0) // bucket_bytes))
    keyed = _numbered(docs, F.xxhash64(F.lit(seed), *[_plain(f) for f in docs.schema.fields]), key)
    scattered = keyed.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(buckets)).cast("long"))
    starts = materialise(_starts(scattered.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))), "shard-starts")

    # The permutation is drawn by number, so texts stay out of Python; it has a number for each record
    # and is never broadcast.
    drawn = starts.mapInArrow(_places(seed), "bucket long, places array<long>").select(F.col("bucket").alias(of), F.col("places").alias(places))
    ties = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, (T.StringType, T.NumericType))]
    ordered = scattered.withColumn(no, F.row_number().over(Window.partitionBy(bucket).orderBy(key, *ties)))
    placed = ordered.join(drawn.hint("merge"), F.col(bucket) == F.col(of)).withColumn(at, F.get(places, F.col(no) - 1))
    base, extra = divmod(rows, shards)
    edge = extra * (base + 1)
    cut = lambda op, lead: F.expr(f"CASE WHEN `{at}` < {edge}L THEN `{at}` {op} {base + 1}L ELSE {lead} + (`{at}` - {edge}L) {op} {max(base, 1)}L END")
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], cut("div", extra).cast("int").alias("shard"), cut("%", 0).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows by slot; a rerun replaces the table as a whole."""
    (sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path))


def shard_digest(sharded: DataFrame, *, text_col: str = "text") -> DataFrame:
    return sharded.select(
        "doc_id",
        record_size(text_col).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
