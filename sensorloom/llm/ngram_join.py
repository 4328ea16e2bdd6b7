"""N-gram Jaccard join: a size-aware heavy-light self-join of word-shingle sets.

Sets smaller than a boundary enumerate their fixed-size subsets (any two that are similar share one
of the overlap's size); larger ones, and small ones that may match them, go into inverted lists over
the rarest part of each set, which are scanned.  The boundary is chosen by cost: subsets to be
enumerated below it, against list entries that the sets from there on would scan, as measured.

1. One scan hashes shingles.  In hash order, the first a - ceil(t a) + l of a set's a elements hold
   l elements of any set similar to it, whose own such prefix holds them too.  Sets with fewer
   repeated elements there have no partner and leave the join.  Equal sets become one.
2. Among the rest, elements are counted, and each set joins the lists of its rarest elements; the
   lists' lengths give the boundary, and sets below it leave the lists for those of their subsets.
3. Lists are resolved by pivots, those with most shared elements first: all members are compared
   with the pivot, linked ones fall into one component, and pairs within a component need no
   comparison.  The number of pivots grows fourfold a round until every list is one component or all its pairs
   across components have been compared.  So no group is expanded into all of its pairs because
   its members are alike.
4. Any link lies within a component, so links are counted there: a component is dealt into blocks,
   and a matrix product of two blocks has all their overlaps.  Rows grow with the number of blocks;
   only ``jaccard_links`` has a row for each pair.

Edge cases: sets without words are empty and linked with nothing; a row whose id is null gets its
size and a null component and links nothing; rows of one id and different texts are separate
documents, told apart by a hash of the text (``keys``); repeated rows fall into one class; a very
long text is a large set, handled whole; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import repeats
from sensorloom.llm.common import BROADCAST_ROWS, Words, gram_hashes, materialise, mix64, release, text_bytes, text_chunks
from sensorloom.llm.components import components

_U = np.uint64
#: The join's threshold as a fraction: intersection / union >= _T / _OF.
_T, _OF = 4, 5
#: Sets beyond this size never enumerate: one of 64 elements has over 10^9 subsets.
_LARGEST = 64
#: Elements that a worker gathers before it sends them on.
_EMIT = 100_000
#: Comparisons of a set with a list's pivots that the boundary's cost counts at most.
_SETTLED = 4
#: Partners of a pivot that one task compares; a class is hot if it has more than one in _HOT rows.
_PARTNERS, _HOT = 4096, 1000
#: Sets and elements of a block of a component, and columns of its matrix at a time.
_BLOCK_SETS, _BLOCK_ELEMENTS, _COLUMNS = 1024, 1_000_000, 2048
_SCAN = "kind int, bucket int, chunk long, keys binary, payload binary, ids array<long>, xs array<long>, s1 array<long>, s2 array<long>, sizes array<int>, alias array<int>, known array<int>"


def least_overlap(a: int) -> int:
    """Elements that a set of ``a`` shares with any similar set."""
    return -(-_T * a // _OF)


def spare(a: int) -> int:
    """Elements looked for beyond the first common one."""
    return max(1, -(-a // 10))


def overlap_needed(a: int, b: int) -> int:
    return -(-_T * (a + b) // (_T + _OF))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and _OF * common >= _T * (len(a) + len(b) - common)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a short text is one shingle."""
    words = Words(texts, lower=True)
    grams = gram_hashes(words.hashes, k)
    sets = []
    for lo, hi in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            sets.append(np.unique(grams[lo : hi - k + 1]))
        else:
            sets.append(mix64(gram_hashes(words.hashes[lo:hi], hi - lo) + _U(hi - lo)) if hi > lo else np.empty(0, np.uint64))
    return sets


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        one = mix64(s).sum(dtype=np.uint64) + mix64(np.array([len(s)], dtype=np.uint64))[0]
        two = mix64(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _scan(k: int, buckets: int):
    """Prefix elements in blocks, and a row with the ids, digests and sizes of the block's texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("payload", pa.binary()), ("ids", pa.list_(pa.int64())), ("xs", pa.list_(pa.int64())), ("s1", pa.list_(pa.int64())), ("s2", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("alias", pa.list_(pa.int32())), ("known", pa.list_(pa.int32()))])
        part = TaskContext.get().partitionId()
        state = {"n": 0, "keys": [], "owner": [], "ids": [], "xs": [], "dig": [], "sizes": [], "alias": [], "seen": {}, "no": 0}

        def flush() -> pa.RecordBatch:
            chunk = (part << 24) + state["no"]
            keys = np.concatenate([np.empty(0, np.uint64), *state["keys"]])
            owner = np.concatenate([np.empty(0, np.uint32), *state["owner"]])
            blocks, known = repeats.split(keys, owner, buckets)
            counts = np.bincount(known, minlength=len(state["ids"])).tolist()
            rows = [{"kind": 0, "bucket": b, "chunk": chunk, "keys": x, "payload": y} for b, x, y in blocks]
            rows.append({"kind": 1, "bucket": -1 - chunk % buckets, "chunk": chunk, "ids": state["ids"], "xs": state["xs"], "s1": [d[0] for d in state["dig"]], "s2": [d[1] for d in state["dig"]], "sizes": state["sizes"], "alias": state["alias"], "known": counts})
            state.update(n=0, keys=[], owner=[], ids=[], xs=[], dig=[], sizes=[], alias=[], seen={}, no=state["no"] + 1)
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for lo, hi in text_chunks(batch, "t"):
                for i, x, s in zip(batch.column("i").slice(lo, hi - lo).to_pylist(), batch.column("x").slice(lo, hi - lo).to_pylist(), shingle_sets(text_bytes(batch, lo, hi, "t"), k), strict=True):
                    at, dig = len(state["ids"]), digest(s)
                    first = state["seen"].setdefault(dig, at) if len(s) and i is not None else at
                    state["ids"].append(i)
                    state["xs"].append(x)
                    state["dig"].append(dig)
                    state["sizes"].append(len(s))
                    state["alias"].append(first)
                    if first == at and len(s) and i is not None:
                        prefix = s[: len(s) - least_overlap(len(s)) + spare(len(s))]
                        state["keys"].append(prefix)
                        state["owner"].append(np.full(len(prefix), at, np.uint32))
                        state["n"] += len(prefix)
                if state["n"] >= repeats.BLOCK_KEYS or len(state["ids"]) >= 200_000:
                    yield flush()
                    release()
        if state["ids"]:
            yield flush()
        release()

    return run


def _count(table: pa.Table) -> pa.Table:
    """One block's texts with the number of their prefix elements that repeat."""
    own = table.filter(pc.is_valid(table["ids"]))
    counts = np.array(own["known"][0].as_py(), dtype=np.int64)
    for data in table["payload"].drop_null().to_pylist():
        counts += np.bincount(repeats.unpack(data, np.uint32), minlength=len(counts))
    alias = np.array(own["alias"][0].as_py(), dtype=np.int64)
    flat = {c: own[c][0].values for c in ("ids", "xs", "s1", "s2", "sizes")}
    return pa.table({"doc_id": flat["ids"], "x": flat["xs"], "s1": flat["s1"], "s2": flat["s2"], "n": flat["sizes"], "shared": pa.array(counts[alias], pa.int64())})


@lru_cache(maxsize=4096)
def overlaps(a: int, below: int) -> tuple[int, ...]:
    """Overlaps that a set of ``a`` may need with a similar set smaller than ``below``."""
    return tuple(sorted({overlap_needed(a, b) for b in range(least_overlap(a), min(below, a * _OF // _T + 1)) if overlap_needed(a, b) <= min(a, b)}))


def subset_count(a: int, below: int) -> int:
    return sum(comb(a, c) for c in overlaps(a, below))


def boundary(sizes: dict[int, tuple[int, int]]) -> int:
    """Where enumeration stops, from ``size -> (sets, list entries that they scan)``.

    The least total of subsets enumerated below it and of entries scanned by the sets that may have a
    partner from there on.  The search ends where subsets alone cost more than the best total.
    """
    best, at = None, 1
    for x in range(1, _LARGEST + 2):
        subsets = sum(n * subset_count(a, x) for a, (n, _) in sizes.items() if a < x)
        if best is not None and subsets >= best:
            break
        scanned = sum(entries for a, (_, entries) in sizes.items() if a >= least_overlap(x))
        if best is None or subsets + scanned < best:
            best, at = subsets + scanned, x
    return at


@lru_cache(maxsize=256)
def _choices(a: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(a), c)), dtype=np.int64)


def _subsets(s: np.ndarray, below: int) -> np.ndarray:
    """Keys of the subsets that a small set shares with each similar small set."""
    mixed, out = mix64(s), [np.empty(0, np.uint64)]
    with np.errstate(over="ignore"):
        for c in overlaps(len(s), below):
            out.append(mix64(mixed[_choices(len(s), c)].sum(axis=1, dtype=np.uint64) * _U(31) + _U(c)))
    return np.unique(np.concatenate(out)).view(np.int64)


def _sets(k: int):
    """Texts of class representatives as (sid, n, z): only those that are what was asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_chunks(batch, "t"):
                texts = text_bytes(batch, lo, hi, "t")
                wanted = zip(batch.column("s1").slice(lo, hi - lo).to_pylist(), batch.column("s2").slice(lo, hi - lo).to_pylist(), strict=True)
                rows = [(w[0], len(s), pa.compress(t, codec="zstd", asbytes=True), len(t)) for w, s, t in zip(wanted, shingle_sets(texts, k), texts, strict=True) if w == digest(s)]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64())], ["sid", "n", "z", "size"])

    return run


def _load(z: bytes, size: int, k: int) -> np.ndarray:
    return shingle_sets([pa.decompress(z, decompressed_size=size, codec="zstd", asbytes=True) if size else b""], k)[0]


def _elements(k: int, below: int | None = None):
    """(h, sid, n) for the elements of sets or, with ``below``, for their subset keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs: list[np.ndarray] = []
        sids: list[int] = []
        ns: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            lens = [len(h) for h in hs]
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.repeat(np.array(sids, np.int64), lens)), pa.array(np.repeat(np.array(ns, np.int32), lens))], ["h", "sid", "n"])
            hs.clear()
            sids.clear()
            ns.clear()
            held = 0
            return out

        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                for sid, n, z, size in zip(*(batch.slice(row, 64).column(c).to_pylist() for c in ("sid", "n", "z", "size")), strict=True):
                    h = _load(z, size, k)
                    hs.append(h.view(np.int64) if below is None else _subsets(h, below))
                    sids.append(sid)
                    ns.append(n)
                    held += len(hs[-1])
                    if held >= _EMIT:
                        yield flush()
        if hs:
            yield flush()
        release()

    return run


def _lists(sets: DataFrame, k: int) -> tuple[DataFrame, int]:
    """``h, sid, n, place``: members of every list, with the element's place in the set's order; and the boundary."""
    elements = sets.mapInArrow(_elements(k), "h long, sid long, n int")
    counts = elements.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = elements.join(counts, "h")
    mine = Window.partitionBy("sid")  # a set's own elements
    placed = (
        shared.withColumn("alone", F.col("n") - F.count(F.lit(1)).over(mine))
        .withColumn("place", F.col("alone") + F.row_number().over(mine.orderBy("df", "h")))
        .filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * _T / _OF) + 1)
        .select("h", "sid", "n", "df", F.col("place").cast("int").alias("place"))
    )
    placed = materialise(placed, "join-lists")
    size = F.least("n", F.lit(_LARGEST + 1)).alias("size")  # all larger ones are one row
    # an entry, and comparisons with the pivots that settle a list of similar sets
    scan = 1 + F.least(F.col("df") - 1, F.lit(_SETTLED))
    cost = placed.groupBy(size).agg(F.count_distinct("sid").alias("sets"), F.sum(scan).alias("entries"))
    below = boundary({r["size"]: (r["sets"], r["entries"]) for r in cost.collect()})
    lists = placed.filter(F.col("n") >= least_overlap(below)).drop("df")
    if below > 1:
        small = sets.filter(F.col("n") < below).mapInArrow(_elements(k, below), "h long, sid long, n int")
        lists = lists.unionByName(small.withColumn("place", F.lit(0)))
    return lists, below


def _compare(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                links = []
                for r in batch.slice(row, 256).to_pylist():
                    if r["pivot"] not in held:
                        if len(held) >= 64:
                            held.clear()
                        held[r["pivot"]] = _load(r["pz"], r["psize"], k)
                    if similar(_load(r["z"], r["size"], k), held[r["pivot"]]):
                        links.append((r["label"], r["plabel"]))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
        held.clear()
        release()

    return run


def _link(sets: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """``node, label`` of all sets that are linked with another."""
    shares = lists.groupBy("sid").agg(F.count(F.lit(1)).alias("shares"))
    members = materialise(lists.join(shares, "sid").withColumn("label", F.col("sid")), "join-members")
    labels = materialise(shares.select(F.col("sid").alias("node"), F.col("sid").alias("label")), "join-labels")
    done, pivots = 0, 1
    while True:
        span = members.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("len")).filter("lo <> hi")
        open_lists = materialise(span.select("h", "len"), "join-open")
        longest = open_lists.agg(F.max("len")).first()[0]
        if longest is None or done >= longest:
            break
        live = materialise(members.join(open_lists.select("h"), "h"), "join-live")
        rank = Window.partitionBy("h").orderBy(F.desc("shares"), "sid")
        # row_number up to a constant is cut before the shuffle, so a long list sends its first rows only
        chosen = live.withColumn("no", F.row_number().over(rank)).filter(F.col("no") <= pivots).filter(F.col("no") > done)
        chosen = chosen.select("h", F.col("sid").alias("pivot"), F.col("n").alias("pn"), F.col("place").alias("pplace"), F.col("label").alias("plabel"), F.col("shares").alias("pshares"))
        chosen = materialise(chosen, "join-pivots")  # a plain side: the join below can split long lists
        need = F.ceil((F.col("n") + F.col("pn")) * _T / (_T + _OF))
        room = 1 + F.least(F.col("n") - F.col("place"), F.col("pn") - F.col("pplace"))
        later = (F.col("shares") < F.col("pshares")) | ((F.col("shares") == F.col("pshares")) & (F.col("sid") > F.col("pivot")))
        pairs = (
            live.join(chosen, "h")
            .filter((F.col("label") != F.col("plabel")) & later & (_OF * F.least("n", "pn") >= _T * F.greatest("n", "pn")) & ((F.col("place") == 0) | (room >= need)))
            .select("sid", "pivot", "label", "plabel").distinct()
        )
        found = materialise(_with_texts(materialise(pairs, "join-pairs"), sets).mapInArrow(_compare(k), "a long, b long"), "join-links")
        done, pivots = pivots, pivots * 4
        if found.isEmpty():
            members = live
            continue
        # what is linked are whole components by now: only their labels are united
        united = components(found).withColumnsRenamed({"node": "__was", "label": "__now"})
        side = F.broadcast(united) if united.count() <= BROADCAST_ROWS else united
        labels = labels.join(side, F.col("label") == F.col("__was"), "left").select("node", F.coalesce("__now", "label").alias("label"))
        labels = materialise(labels, "join-labels")
        members = live.drop("label").join(labels.withColumnRenamed("node", "sid"), "sid")
        members = materialise(members.select(*live.columns), "join-members")
    several = labels.filter("node <> label").select("label").distinct()
    return labels.join(several, "label").select("node", "label")


def _with_texts(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Both texts of each pair; a pivot with very many partners is dealt to several tasks."""
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / _PARTNERS).alias("parts")).filter("parts > 1")
    parts = materialise(parts, "join-parts")  # one row for _PARTNERS pairs at most
    hot = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    a = sets.select("sid", "z", "size")
    b = sets.select(F.col("sid").alias("pivot"), F.col("z").alias("pz"), F.col("size").alias("psize"))
    b = b.join(pairs.select("pivot").distinct(), "pivot").join(hot, "pivot", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    dealt = pairs.join(hot, "pivot", "left").withColumn("part", F.pmod(F.xxhash64("sid"), F.coalesce("parts", F.lit(1)))).drop("parts")
    return dealt.join(a, "sid").join(b, ["pivot", "part"])


def _tally(k: int, pairs: bool):
    """All links between two blocks of a component: their pairs, or the members that each set links with."""

    def run(table: pa.Table) -> pa.Table:
        sid = table["sid"].to_numpy()
        members = table["members"].to_numpy().astype(np.float64)
        block = table["block"].to_numpy()
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        sets = [_load(z, size, k) for z, size in zip(table["z"].to_pylist(), table["size"].to_pylist(), strict=True)]
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1  # elements of one set alone take no column
        repeats_here = times[column] > 1
        owner, column = owner[repeats_here], number[column[repeats_here]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        common = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
            a, b = np.searchsorted(column, (start, start + _COLUMNS))
            has = np.zeros((len(sets), min(_COLUMNS, int(column[-1]) + 1 - start)), np.float32)
            has[owner[a:b], column[a:b] - start] = 1
            common += has[left] @ has[right].T
        linked = (common > 0) & (_OF * common >= _T * (sizes[left][:, None] + sizes[right][None, :] - common))
        if lo == hi:
            np.fill_diagonal(linked, False)
        if pairs:
            x, y = np.nonzero(np.triu(linked) if lo == hi else linked)
            return pa.table({"a": pa.array(sid[left[x]], pa.int64()), "b": pa.array(sid[right[y]], pa.int64())})
        found = [(sid[left], linked @ members[right])] + ([(sid[right], linked.T @ members[left])] if lo != hi else [])
        return pa.table({"sid": pa.array(np.concatenate([f[0] for f in found]), pa.int64()), "links": pa.array(np.concatenate([f[1] for f in found]).astype(np.int64), pa.int64())})

    return run


def _within(sets: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Sets of each component, in pairs of blocks: any two sets of it stand together in one pair.

    Blocks are bounded by sets and elements, so a large component is many groups, none of them large.
    """
    members = classes.select(F.col("s1").alias("sid"), "members")
    linked = materialise(sets.join(labels.withColumnRenamed("node", "sid"), "sid").join(members, "sid"), "join-linked")
    parts = linked.groupBy("label").agg(F.ceil(F.greatest(F.count(F.lit(1)) / _BLOCK_SETS, F.sum(F.col("n").cast("long")) / _BLOCK_ELEMENTS)).alias("parts"))
    parts = materialise(parts.filter("parts > 1"), "join-parts")  # one row for a block's worth of sets at most
    side = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    several = linked.join(side, "label", "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    placed = several.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("parts"))).withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    return placed.select("label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "sid", "members", "z", "size")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows, classes of equal sets, the sets of those that may be linked, and the labels of those that are."""
    source = docs.select(docs[id_col].cast("long").alias("i"), F.xxhash64(docs[text_col]).alias("x"), docs[text_col].alias("t"))
    total = source.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = repeats.buckets_for(total)
    scan = materialise(source.mapInArrow(_scan(shingle, buckets), _SCAN), "join-scan")
    replies = repeats.tell(scan.filter("kind = 0").select("bucket", "chunk", "keys", "payload"), buckets, scan.filter("kind = 1").count())
    own = scan.filter("kind = 1").select("chunk", F.lit(None).cast("binary").alias("payload"), "ids", "xs", "s1", "s2", "sizes", "alias", "known")
    told = own.unionByName(replies, allowMissingColumns=True).groupBy("chunk").applyInArrow(_count, "doc_id long, x long, s1 long, s2 long, n int, shared long")
    rows = materialise(told, "join-rows")

    with_id = rows.filter("n > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "x"))
    classes = with_id.groupBy("s1", "s2").agg(least.alias("c"), F.max("n").alias("n"), F.max("shared").alias("shared"), F.count(F.lit(1)).alias("members"))
    classes = materialise(classes.select("s1", "s2", F.col("c.doc_id").alias("class_id"), F.col("c.x").alias("class_x"), "n", "shared", "members"), "join-classes")
    c = F.ceil(F.col("n") * _T / _OF)
    maybe = materialise(classes.filter(F.col("shared") >= F.greatest(F.lit(1), F.ceil(c / 10))).select("class_id", "class_x", "s1", "s2"), "join-maybe")
    side = F.broadcast(maybe) if maybe.count() <= BROADCAST_ROWS else maybe
    own_text = source.join(side, (F.col("i") == F.col("class_id")) & (F.col("x") == F.col("class_x"))).select("s1", "s2", "t")
    sets = materialise(own_text.mapInArrow(_sets(shingle), "sid long, n int, z binary, size long").dropDuplicates(["sid"]), "join-sets")
    lists, _ = _lists(sets, shingle)
    return rows, classes, sets, _link(sets, lists, shingle)


def jaccard_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``a, b``: every pair of linked classes, as their ``class_id``, the smaller one first.

    As many rows as there are links, which is the square of a group's size; ``n_links`` of
    ``jaccard_components`` counts the same links without a row for each.
    """
    _, classes, sets, labels = _classes(docs, id_col, text_col, shingle)
    found = _within(sets, labels, classes).groupBy("label", "lo", "hi").applyInArrow(_tally(shingle, True), "a long, b long")
    name = lambda c: classes.select(F.col("s1").alias(c), F.col("class_id").alias(f"{c}_id"))
    named = found.join(name("a"), "a").join(name("b"), "b")
    return named.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, links: bool = False, keys: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` for every row of ``docs``.

    ``id_col`` must hold whole numbers.  ``class_id`` is the smallest id with an equal set.
    With ``links`` also ``n_links``: the other rows whose set is similar or equal.  With ``keys`` also
    ``text_key`` and ``component_key``: where ids repeat, a document is its id with the hash of its
    text, and a component's first document is ``component_id`` with ``component_key``.
    """
    rows, classes, sets, labels = _classes(docs, id_col, text_col, shingle)
    linked = labels.join(classes, F.col("node") == F.col("s1")).select("s1", "s2", "label", "class_id", "class_x")
    least = linked.groupBy("label").agg(F.min(F.struct("class_id", "class_x")).alias("first"))
    part = linked.join(least, "label").select("s1", "s2", "first")
    whole = classes.join(part, ["s1", "s2"], "left").select("s1", "s2", "class_id", F.coalesce("first", F.struct("class_id", "class_x")).alias("first"), "members")
    if links:
        tallied = _within(sets, labels, classes).groupBy("label", "lo", "hi").applyInArrow(_tally(shingle, False), "sid long, links long")
        tallied = tallied.groupBy(F.col("sid").alias("s1")).agg(F.sum("links").alias("links"))
        whole = whole.join(tallied, "s1", "left").withColumn("n_links", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).cast("long"))
    else:
        whole = whole.withColumn("n_links", F.lit(None).cast("long"))
    told = F.struct("class_id", F.col("first.class_id").alias("component_id"), F.col("first.class_x").alias("component_key"), "n_links").alias("told")
    whole = materialise(whole.select("s1", "s2", "members", told), "join-whole")

    # Classes of more than one in _HOT rows are fewer than _HOT: they are broadcast, and no key of the
    # shuffled join has more rows than that.  Rows without a class need no join.
    hot = whole.filter(F.col("members") > rows.count() // _HOT).select("s1", "s2", "told")
    filled = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    met = rows.filter(filled).join(F.broadcast(hot), ["s1", "s2"], "left")
    rest = met.filter("told is null").drop("told").join(whole.select("s1", "s2", "told"), ["s1", "s2"])
    none = rows.filter(~F.coalesce(filled, F.lit(False))).withColumn("told", F.lit(None).cast(whole.schema["told"].dataType))
    every = met.filter("told is not null").unionByName(rest).unionByName(none)
    own = lambda c, other: F.when(F.col("told").isNotNull(), F.col(f"told.{c}")).otherwise(other).alias(c)
    out = [F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), own("component_id", F.col("doc_id")), own("class_id", F.col("doc_id"))]
    out += [own("n_links", F.lit(0).cast("long"))] if links else []
    out += [F.col("x").alias("text_key"), own("component_key", F.col("x"))] if keys else []
    return every.select(*out)
