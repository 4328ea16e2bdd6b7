"""Benchmark decontamination: Wu-Manber search over words for many passages at once.

The symbols are words, the patterns all windows of ``window`` words of the benchmark items (one
shorter pattern for a shorter item).  For the patterns of one length, a table tells for every
block of two words how far the search may jump; a block that ends a pattern leads to a bucket of
patterns by the hash of their suffix, and comparison of all words confirms.

The benchmark is read in blocks of a bounded size, each searched in all documents; so no
broadcast grows without bound.  Edge cases: a null or word-less text has no words and no hits, a
word-less item no window; equal items all count; repeated documents give repeated results; an
empty benchmark marks nothing; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.common import materialise, text_bytes, text_chunks

WINDOW, ONE_IN = 13, 20
#: Words of benchmark text searched for at once.
BLOCK_WORDS = 2_000_000

#: A-Z to lower case; ASCII other than letters and digits to blanks; other bytes as they are.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WuManber:
    """All patterns of ``m`` words: shifts by block, candidates by the block that ends a pattern."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for words, items in patterns.items():
            for end in range(self.block, m + 1):
                key = words[end - 2 : end] if self.block == 2 else words[0]
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            last = words[m - 2 :] if self.block == 2 else words[0]
            self.bucket.setdefault(last, {})[words] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """First word and items of every occurrence."""
        m, n, get, default = self.m, len(words), self.shift.get, self.default
        at = m - 1
        if self.block == 2:
            while at < n:
                jump = get((words[at - 1], words[at]), default)
                if jump:
                    at += jump
                    continue
                yield from self._confirm(words, at, (words[at - 1], words[at]))
                at += 1
        else:
            while at < n:
                if get(words[at], default) == 0:
                    yield from self._confirm(words, at, words[at])
                at += 1

    def _confirm(self, words: list[bytes], at: int, last) -> Iterator[tuple[int, list[int]]]:
        items = self.bucket[last].get(tuple(words[at - self.m + 1 : at + 1]))  # compares all words
        if items:
            yield at - self.m + 1, items


def compile_patterns(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    """``items``: number and text; one searcher for every length of pattern."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for number, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            owners = by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), [])
            if not owners or owners[-1] != number:
                owners.append(number)
    return [WuManber(m, p) for m, p in sorted(by_length.items())]


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any of the spans [from, to)."""
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, str, bytes]]]:
    """Items (number, id, text) in blocks of bounded size, without holding the whole table."""
    block, size = [], 0
    for number, r in enumerate(benchmark.select(item_col, text_col).orderBy(item_col, text_col).toLocalIterator()):
        text = (r[1] or "").encode()
        block.append((number, "" if r[0] is None else str(r[0]), text))
        size += len(text) // 2 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, columns: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, one_in: int = ONE_IN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``columns`` of ``docs`` plus n_words, n_hit, hit_items (sorted as strings), hit_spans.

    With more than one block of benchmark text, each document passes all blocks in turn; spans
    and items of earlier blocks travel along, so a document is still one row.
    """
    new = ["n_words", "n_hit", "hit_items", "hit_spans", "contaminated"]
    columns = [c for c in columns if c not in new]
    spark = docs.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    out = T.StructType([*(docs.schema[c] for c in columns), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", span), T.StructField("__t", docs.schema[text_col].dataType)])
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def scan(patterns, names, fields):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searchers, name = patterns.value, names
            for batch in batches:
                for lo, hi in text_chunks(batch, "__t"):
                    part = batch.slice(lo, hi - lo)
                    n_words, n_hit, items, spans = [], [], [], []
                    earlier = part.column("hit_spans").to_pylist(), part.column("hit_items").to_pylist()
                    for text, old_spans, old_items in zip(text_bytes(part, 0, part.num_rows, "__t"), *earlier, strict=True):
                        words = words_of(text)
                        hits = {(s["first"], s["last"] + 1) for s in old_spans}
                        found = set(old_items)
                        for w in searchers:
                            for at, owners in w.search(words):
                                hits.add((at, at + w.m))
                                found.update(name[i] for i in owners)
                        merged: list[list[int]] = []
                        for a, b in sorted(hits):
                            if merged and a <= merged[-1][1]:
                                merged[-1][1] = max(merged[-1][1], b)
                            else:
                                merged.append([a, b])
                        n_words.append(len(words))
                        n_hit.append(covered([(a, b) for a, b in merged]))
                        items.append(sorted(found))
                        spans.append([{"first": a, "last": b - 1} for a, b in merged])
                    arrays = [*(part.column(c) for c in columns), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span_type), part.column("__t")]
                    yield pa.RecordBatch.from_arrays(arrays[: len(fields)], fields)

        return run

    def passes(block, last: bool) -> DataFrame:
        patterns = spark.sparkContext.broadcast(compile_patterns([(n, t) for n, _, t in block], window))
        fields = T.StructType(out.fields[:-1] if last else out.fields)
        scanned = result.mapInArrow(scan(patterns, {n: i for n, i, _ in block}, fields.fieldNames()), fields)
        if last:
            return scanned
        kept = materialise(scanned, "decontam-block")  # one block at a time is held by the executors
        patterns.destroy()
        return kept

    result = docs.select(*columns, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("hit_items"), F.array().cast("array<struct<first:int,last:int>>").alias("hit_spans"), docs[text_col].alias("__t"))
    held: list = []
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        if held:
            result = passes(held, last=False)
        held = block
    result = passes(held, last=True)
    rule = (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))
    return result.withColumn("contaminated", rule)


def contamination_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")

