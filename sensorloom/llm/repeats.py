"""Which 64-bit keys occur more than once in a corpus, told back to where they occur.

Workers send their distinct keys in compressed cells, one a range of the key space, and a task a
range finds the keys that several workers hold.  A key that repeats inside one block is sent once,
however often it occurs, so hot keys cost one entry a block.  Keys are cut to 32 bits beyond the
bucket: two keys may rarely pass for one, so "repeats" is a filter without false negatives.

A block is cut into ``FAN`` cells at most.  Where that makes ranges too large for a task, a second
level follows: ``FAN`` blocks at a time are merged within a range, and what is left of them is cut
into finer cells.  So cells per key stay the same however large the corpus is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import materialise, mix64

#: Keys that a worker gathers before it sends a block.
BLOCK_KEYS = 1_000_000
#: Text bytes a bucket of the key space stands for.
BUCKET_BYTES = 24 << 20
#: Cells of a block, and blocks that the second level merges.
FAN = 1024
_U = np.uint64
_KNOWN = np.uint32(0xFFFFFFFF)


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an integer array, by byte plane."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if n == 0:
        return np.empty(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).ravel()


def buckets_for(text_bytes: int) -> int:
    return max(4, -(-text_bytes // BUCKET_BYTES))


def ranges_for(buckets: int) -> int:
    return min(buckets, FAN)


def split(keys: np.ndarray, payload: np.ndarray, buckets: int) -> tuple[list[tuple[int, bytes, bytes]], np.ndarray]:
    """Cells (range, keys, payload) of the distinct keys, and the payloads already known to repeat.

    In a cell a payload of the largest uint32 stands for a key whose payloads are all known.
    """
    order = np.argsort(keys, kind="stable")
    keys, payload = keys[order], payload[order].astype(np.uint32)
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
    single = first & np.r_[first[1:], True] if len(keys) else first
    known = payload[~single]
    sent = np.where(single, payload, _KNOWN)[first]
    keys = keys[first]
    ranges = ranges_for(buckets)
    high = (keys >> _U(32)) * _U(ranges) >> _U(32)
    edges = np.searchsorted(high, np.arange(ranges + 1, dtype=np.uint64))
    shift = _U(max(0, 32 - (buckets - 1).bit_length()))
    cells = []
    for b in range(ranges):
        lo, hi = int(edges[b]), int(edges[b + 1])
        if lo < hi:
            short = keys[lo:hi] >> shift
            cells.append((b, pack(np.diff(short, prepend=_U(0))), pack(sent[lo:hi])))
    return cells, known


def repeated(cells: list[tuple[bytes, bytes]]) -> list[np.ndarray]:
    """For every cell of one bucket the payloads whose key another cell holds too."""
    keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k, _ in cells]
    found, counts = np.unique(np.concatenate([np.unique(k) for k in keys]), return_counts=True)
    found = found[counts > 1]
    out = []
    for k, (_, p) in zip(keys, cells, strict=True):
        payload = unpack(p, np.uint32)
        at = np.minimum(np.searchsorted(found, k), max(0, len(found) - 1))
        twice = np.zeros(len(k), bool)  # short forms that fall together inside a cell
        same = k[1:] == k[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        hit = (found[at] == k if len(found) else np.zeros(len(k), bool)) | twice
        out.append(payload[hit & (payload != _KNOWN)])
    return out


def _resolve(table: pa.Table) -> pa.Table:
    """One bucket of blocks' cells: tells each block which of its payloads repeat elsewhere."""
    cells = list(zip(table["keys"].to_pylist(), table["payload"].to_pylist(), strict=True))
    return pa.table({"chunk": table["chunk"].combine_chunks(), "payload": pa.array([pack(p) for p in repeated(cells)], pa.binary())})


_MERGED = "range int, sub int, chunks array<long>, keys binary, payload binary, owner binary"


def _merge(subs: int):
    """Cells of several blocks in one range: what repeats among them, and finer cells of the rest.

    A finer cell says whose each payload is by a number into the list of blocks.
    """
    schema = pa.schema([("range", pa.int32()), ("sub", pa.int32()), ("chunks", pa.list_(pa.int64())), ("keys", pa.binary()), ("payload", pa.binary()), ("owner", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        chunks, bucket = table["chunk"].to_pylist(), table["bucket"][0].as_py()
        parts = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in table["keys"].to_pylist()]
        keys = np.concatenate(parts)
        payload = np.concatenate([unpack(p, np.uint32) for p in table["payload"].to_pylist()])
        owner = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(p) for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, payload, owner = keys[order], payload[order], owner[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        single = first & np.r_[first[1:], True]
        rows = []
        told = ~single & (payload != _KNOWN)
        for n in np.unique(owner[told]).tolist():
            rows.append({"range": bucket, "sub": -1, "chunks": [chunks[n]], "payload": pack(payload[told & (owner == n)])})
        payload = np.where(single, payload, _KNOWN)[first]
        keys, owner = keys[first], owner[first]
        sub = (mix64(keys) % _U(subs)).astype(np.int64)
        order = np.argsort(sub, kind="stable")
        edges = np.searchsorted(sub[order], np.arange(subs + 1))
        for n in range(subs):
            here = order[edges[n] : edges[n + 1]]
            if len(here):
                rows.append({"range": bucket, "sub": n, "chunks": chunks, "keys": pack(np.diff(keys[here], prepend=_U(0))), "payload": pack(payload[here]), "owner": pack(owner[here])})
        return pa.Table.from_pylist(rows, schema)

    return run


def _resolve_merged(table: pa.Table) -> pa.Table:
    """One fine bucket: payloads that repeat, by the block they are from."""
    keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in table["keys"].to_pylist()]
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    found = found[counts > 1]
    to, out = [], []
    for k, p, o, chunks in zip(keys, *(table[c].to_pylist() for c in ("payload", "owner", "chunks")), strict=True):
        payload, owner = unpack(p, np.uint32), unpack(o, np.uint16)
        hit = np.isin(k, found) & (payload != _KNOWN)
        for n in np.unique(owner[hit]).tolist():
            to.append(chunks[n])
            out.append(pack(payload[hit & (owner == n)]))
    return pa.table({"chunk": pa.array(to, pa.int64()), "payload": pa.array(out, pa.binary())})


def tell(cells: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """``bucket, chunk, keys, payload`` of all blocks to ``chunk, payload``: what repeats elsewhere."""
    reply = "chunk long, payload binary"
    if buckets <= FAN:
        return cells.groupBy("bucket").applyInArrow(_resolve, reply)
    subs, groups = -(-buckets // FAN), -(-blocks // FAN)
    # a group has FAN blocks on average; their numbers are cut to 16 bits
    grouped = cells.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups))).groupBy("bucket", "group")
    merged = materialise(grouped.applyInArrow(_merge(subs), _MERGED), "repeats-merged")
    near = merged.filter("sub < 0").select(F.col("chunks")[0].alias("chunk"), "payload")
    far = merged.filter("sub >= 0").groupBy("range", "sub").applyInArrow(_resolve_merged, reply)
    return near.unionByName(far)
