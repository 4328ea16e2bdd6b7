"""Substring dedup: repeated passages found with FM-indexes over shards of the corpus.

A passage repeats if ``window`` consecutive words of it start earlier too: in a document of smaller
id, or before in the same one.  Each window has an anchor, its word-gram of least hash; equal
windows have equal anchors, so runs of windows with one anchor ("segments") can be dealt by it.

1. One scan hashes anchors; those that occur once are done with (``repeats``).
2. Documents with others are read again.  Equal segments are one: all but its first occurrence go.
   A segment is a run of windows with one anchor hash, so periodic text is one segment.
   An anchor with very many different segments is dealt by window instead, so no shard grows with it.
3. Different segments with one anchor meet in a shard.  The shard is FM-indexed, and backward search
   over the wavelet tree gives each streamed window's matching statistic; where it reaches the
   threshold, the earliest place in the window's range of suffixes tells whether it goes.
4. Documents are rebuilt without the covered words; the covered intervals are reported.

So copies of a segment are told by 128 bits of digests before the index is built, as is every window
of an anchor with very many segments; the index decides on what differs.

Edge cases: a null text has no words; null ids come after all others; rows of one id and
different texts are documents in order of their hash, rows equal in both are one place and do
not remove each other; a very long text is cut into segments as any other; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import repeats
from sensorloom.llm.common import BROADCAST_ROWS, Words, gram_hashes, materialise, text_bytes, text_chunks
from sensorloom.llm.fm_index import FMIndex

_U = np.uint64
#: Words of an anchor; words of a shard; different segments of an anchor before windows are dealt.
ANCHOR, SHARD_WORDS, HOT = 8, 200_000, 1000
_SCAN = "kind int, bucket int, chunk long, keys binary, payload binary, ids array<long>, dig array<long>, words array<long>, sha array<string>, counts array<int>, known binary"


def segments(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and number of anchor places of each segment.

    A segment is a run of windows with one anchor hash; in periodic text it has several places.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return np.empty(0, _U), empty, empty, empty
    grams = gram_hashes(hashes, ANCHOR)
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, window - ANCHOR + 1):
        g = grams[k : k + n]
        less = g < least
        np.copyto(least, g, where=less)
        np.copyto(at, k, where=less)
    place = at + np.arange(n)
    moved = np.r_[True, place[1:] != place[:-1]]
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[first], first, np.diff(np.r_[first, n]), np.add.reduceat(moved.astype(np.int64), first)


def _digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, Words, int, int]]:
    """Row, text, words of its run of texts, and its first and last word there."""
    for lo, hi in text_chunks(batch, "t"):
        texts = text_bytes(batch, lo, hi, "t")
        words = Words(texts)
        for k, text in enumerate(texts):
            yield lo + k, text, words, int(words.bounds[k]), int(words.bounds[k + 1])


def _scan(window: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("payload", pa.binary()), ("ids", pa.list_(pa.int64())), ("dig", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("known", pa.binary())])
        part, no, n = TaskContext.get().partitionId(), 0, 0
        keys: list[np.ndarray] = []
        own: list[np.ndarray] = []
        inside: list[tuple[np.ndarray, np.ndarray]] = []
        docs: list[tuple] = []

        def flush() -> pa.RecordBatch:
            chunk = (part << 24) + no
            every = np.concatenate([np.empty(0, _U), *keys, *(k for k, _ in inside)])
            owner = np.concatenate([np.empty(0, np.uint32), *own, *(o for _, o in inside)])
            blocks, known = repeats.split(every, owner, buckets)
            rows = [{"kind": 0, "bucket": b, "chunk": chunk, "keys": x, "payload": y} for b, x, y in blocks]
            cols = [list(c) for c in zip(*docs, strict=True)]
            rows.append({"kind": 1, "bucket": -1, "chunk": chunk, "ids": cols[0], "dig": cols[1], "words": cols[2], "sha": cols[3], "counts": cols[4], "known": repeats.pack(known)})
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            ids, xs = batch.column("i").to_pylist(), batch.column("x").to_pylist()
            for row, text, words, a, b in _documents(batch):
                h, _, _, places = segments(words.hashes[a:b], window)
                twice = np.flatnonzero(places > 1)  # repeats inside the segment: known at once
                keys.append(h)
                own.append(np.arange(n, n + len(h), dtype=np.uint32))
                inside.append((h[twice], own[-1][twice]))
                n += len(h)
                docs.append((ids[row], xs[row], b - a, _sha(text.split()), len(h)))
                if n >= repeats.BLOCK_KEYS or len(docs) >= 100_000:
                    yield flush()
                    no, n, keys, own, inside, docs = no + 1, 0, [], [], [], []
        if docs:
            yield flush()

    return run


def _tell(table: pa.Table) -> pa.Table:
    """One block's documents with the numbers of their segments whose anchor repeats."""
    own = table.filter(pc.is_valid(table["ids"]))
    found = [repeats.unpack(x, np.uint32) for x in [own["known"][0].as_py(), *table["payload"].drop_null().to_pylist()]]
    every = np.unique(np.concatenate(found)).astype(np.int64)
    ends = np.cumsum(np.array(own["counts"][0].as_py(), np.int64))
    cut = np.searchsorted(every, ends)
    starts = np.r_[0, ends[:-1]]
    of = np.repeat(starts, np.diff(np.r_[0, cut]))
    segs = pa.ListArray.from_arrays(pa.array(np.r_[0, cut].astype(np.int32)), pa.array((every - of).astype(np.int32)))
    flat = {c: own[c][0].values for c in ("ids", "dig", "words", "sha")}
    return pa.table({"doc_id": flat["ids"], "dig": flat["dig"], "n_words": flat["words"], "sha": flat["sha"], "segs": segs})


def _occurrences(window: int, by_window: bool):
    """(h, d, doc_id, dig, at, n, no, inner): wanted segments, or their windows one by one.

    Anchor and digest tell a segment's text with 128 bits; windows dealt alone have two digests.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digs, wanted = (batch.column(c).to_pylist() for c in ("doc_id", "dig", "segs"))
            out: list[tuple] = []
            for row, _, words, a, b in _documents(batch):
                h, first, n, places = segments(words.hashes[a:b], window)
                for s in wanted[row]:
                    i, m = int(first[s]), int(n[s])
                    if by_window:
                        for j in range(i, i + m):
                            text = b" ".join(words.span(a + j, a + j + window - 1).split())
                            out.append((_digest(b"window " + text), _digest(text), ids[row], digs[row], j, 1, s, False))
                    else:
                        d = _digest(b" ".join(words.span(a + i, a + i + m + window - 2).split()))
                        out.append((int(h[s].astype(np.int64)), d, ids[row], digs[row], i, m, s, bool(places[s] > 1)))
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["h", "d", "doc_id", "dig", "at", "n", "no", "inner"])

    return run


_SPANS = "array<struct<first:int,last:int>>"
_OCC = "h long, d long, doc_id long, dig long, at int, n int, no int, inner boolean"


def _spell(window: int):
    """Words of the wanted segments: (h, d, doc_id, dig, at, n, words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digs, wanted = (batch.column(c).to_pylist() for c in ("doc_id", "dig", "need"))
            for row, _, words, a, _b in _documents(batch):
                out = [(w["h"], w["d"], ids[row], digs[row], w["at"], w["n"], words.span(a + w["at"], a + w["at"] + w["n"] + window - 2)) for w in wanted[row]]
                if out:
                    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["h", "d", "doc_id", "dig", "at", "n", "words"])

    return run


def search_shard(rows: list[tuple[tuple, int, list[bytes]]], window: int) -> list[np.ndarray]:
    """For each (document, first word, words) of a shard which of its windows start earlier too.

    ``document`` is a sortable key; windows of one document are ordered by their first word.
    """
    numbers: dict[bytes, int] = {}
    symbols, owner_place, bounds = [0], [0], []
    rank = {d: i for i, d in enumerate(sorted({d for d, _, _ in rows}))}
    for doc, at, words in rows:
        bounds.append(len(symbols))
        symbols += [numbers.setdefault(w, len(numbers) + 1) for w in words]
        owner_place += [(rank[doc] << 32) + at + j for j in range(len(words))]
        symbols.append(0)
        owner_place.append(0)
    text, place = np.array(symbols, np.int64), np.array(owner_place, np.int64)
    index = FMIndex(text)
    counts = np.array([len(w) - window + 1 for _, _, w in rows], np.int64)
    starts = np.repeat(np.array(bounds) - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    matched, lo, hi = index.search(text, starts + window, window)
    gone = np.zeros(len(starts), bool)
    hit = np.flatnonzero(matched >= window)
    if len(hit):
        ranges, of = np.unique(lo[hit], return_inverse=True)
        ends = np.zeros(len(ranges), np.int64)
        ends[of] = hi[hit]
        sizes = ends - ranges  # windows are equally long, so their ranges do not overlap
        first = np.cumsum(sizes) - sizes
        suffixes = np.repeat(ranges - first, sizes) + np.arange(sizes.sum())
        earliest = np.minimum.reduceat(place[index.locate(suffixes)], first)
        gone[hit] = earliest[of] < place[starts[hit]]
    return np.split(gone, np.cumsum(counts)[:-1])


def _shard(window: int):
    def run(table: pa.Table) -> pa.Table:
        cols = {c: table[c].to_pylist() for c in ("doc_id", "dig", "at", "words")}
        rows = [((i is None, i or 0, d), at, w.split()) for i, d, at, w in zip(*cols.values(), strict=True)]
        gone = search_shard(rows, window)
        return pa.table({"h": table["h"], "d": table["d"], "gone": pa.array([np.packbits(g).tobytes() for g in gone], pa.binary())})

    return run


def _rebuild(window: int):
    """(doc_id, n_words, n_removed, kept_sha256, kept, spans) of documents with their windows that go."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("marks").to_pylist()
            out = []
            for row, text in ((r, t) for lo, hi in text_chunks(batch, "t") for r, t in zip(range(lo, hi), text_bytes(batch, lo, hi, "t"), strict=True)):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                for m in marks[row] or ():
                    if m["gone"] is None:
                        w = np.arange(m["at"], m["at"] + m["n"])
                    else:
                        w = m["at"] + np.flatnonzero(np.unpackbits(np.frombuffer(m["gone"], np.uint8))[: m["n"]])
                    np.add.at(edge, w, 1)
                    np.add.at(edge, w + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                turns = np.flatnonzero(np.diff(np.r_[True, keep, True].astype(np.int8))).reshape(-1, 2)
                spans = [{"first": a, "last": b - 1} for a, b in turns.tolist()]
                out.append((ids[row], len(words), len(words) - len(kept), _sha(kept), b" ".join(kept).decode("utf-8", "replace"), spans))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return run


def _side(df: DataFrame, lists: str) -> DataFrame:
    """Broadcast while rows and entries of their lists are few, else shuffled."""
    size = df.agg(F.sum(F.size(lists) + 1)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_ROWS else df


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, hot: int = HOT, shard_words: int = SHARD_WORDS, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, if ``with_text``, ``kept``, null where the
    text stays as it is, and ``spans``: the removed intervals, as first and last word from 0.

    ``id_col`` must hold whole numbers.  ``hot`` different segments or ``shard_words`` words are the
    most that an anchor brings to a shard whole.
    """
    if not ANCHOR <= window:
        raise ValueError(f"a window has at least {ANCHOR} words")
    source = docs.select(docs[id_col].cast("long").alias("i"), F.xxhash64(docs[text_col]).alias("x"), docs[text_col].alias("t"))
    total = source.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = repeats.buckets_for(total)
    scan = materialise(source.mapInArrow(_scan(window, buckets), _SCAN), "dedup-scan")
    replies = repeats.tell(scan.filter("kind = 0").select("bucket", "chunk", "keys", "payload"), buckets, scan.filter("kind = 1").count())
    own = scan.filter("kind = 1").select("chunk", F.lit(None).cast("binary").alias("payload"), "ids", "dig", "words", "sha", "counts", "known")
    told = own.unionByName(replies, allowMissingColumns=True).groupBy("chunk").applyInArrow(_tell, "doc_id long, dig long, n_words long, sha string, segs array<int>")
    rows = materialise(told, "dedup-rows")
    plain = rows.filter(F.size("segs") == 0).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"), F.array().cast(_SPANS).alias("spans"))

    some = rows.filter(F.size("segs") > 0).select("doc_id", "dig", "segs").dropDuplicates(["doc_id", "dig"])
    # Texts with repeated anchors, kept aside: the later steps read these only.
    found = source.join(_side(some, "segs"), F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("x") == F.col("dig"))).select("doc_id", "dig", "segs", "t")
    cand = materialise(found, "dedup-texts")
    one_each = cand.groupBy("doc_id", "dig").count().filter("count > 1").isEmpty()
    occ = materialise(cand.mapInArrow(_occurrences(window, False), _OCC), "dedup-places")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("dig").alias("dig"), F.col("at").alias("at"))

    def firsts(of: DataFrame) -> DataFrame:
        return of.groupBy("h", "d").agg(F.min(place).alias("first"), F.max("n").alias("n"), F.max("inner").alias("inner"))

    def several_of(of: DataFrame) -> DataFrame:
        return of.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n").cast("long") + window - 1).alias("words"), F.max("inner").alias("any_inner"))

    each = materialise(firsts(occ), "dedup-first")
    texts_of = several_of(each)
    hot_ones = materialise(texts_of.filter((F.col("c") > hot) | (F.col("words") > shard_words)).select("h"), "dedup-hot")
    if not hot_ones.isEmpty():
        hot_segs = occ.join(hot_ones, "h").groupBy("doc_id", "dig").agg(F.collect_set("no").alias("segs")).select(F.col("doc_id").alias("__id"), F.col("dig").alias("__dig"), "segs")
        again = cand.drop("segs").join(hot_segs, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("dig") == F.col("__dig"))).select("doc_id", "dig", "segs", "t")
        windows = again.mapInArrow(_occurrences(window, True), _OCC)
        occ = materialise(occ.join(hot_ones, "h", "left_anti").select(*occ.columns).union(windows), "dedup-places")
        each = materialise(firsts(occ), "dedup-first")
        texts_of = several_of(each)

    several = materialise(each.join(texts_of.filter("c > 1 or any_inner").select("h"), "h").select("h", "d", "first", "n"), "dedup-several")
    n_words = several.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    need = several.groupBy(F.col("first.doc_id").alias("__id"), F.col("first.dig").alias("__dig")).agg(F.collect_list(F.struct("h", "d", F.col("first.at").alias("at"), "n")).alias("need"))
    spelled = (
        (cand if one_each else cand.dropDuplicates(["doc_id", "dig"])).join(need, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("dig") == F.col("__dig")))
        .select("doc_id", "dig", "need", "t").mapInArrow(_spell(window), "h long, d long, doc_id long, dig long, at int, n int, words binary")
    )
    shards = max(1, -(-n_words // shard_words))
    searched = spelled.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).groupBy("shard").applyInArrow(_shard(window), "h long, d long, gone binary")
    searched = materialise(searched, "dedup-searched")

    key = ["h", "d"]
    # One plain side: the join with all places can split a segment that very many documents hold.
    told = materialise(each.join(searched, key, "left").select(*key, "first", "gone"), "dedup-told")
    marks = (
        occ.join(told, key)
        .withColumn("again", place != F.col("first"))
        .filter("again or gone is not null")
        .select(F.col("doc_id").alias("__id"), F.col("dig").alias("__dig"), F.struct("at", "n", F.when(~F.col("again"), F.col("gone")).alias("gone")).alias("mark"))
        .groupBy("__id", "__dig").agg(F.collect_list("mark").alias("marks"))
    )
    rebuilt = (
        cand.drop("segs").join(marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("dig") == F.col("__dig")), "left").select("doc_id", "t", "marks")
        .mapInArrow(_rebuild(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans " + _SPANS)
    )
    out = plain.unionByName(rebuilt.withColumn("kept", F.when(F.col("n_removed") > 0, F.col("kept"))))
    return out if with_text else out.drop("kept", "spans")
