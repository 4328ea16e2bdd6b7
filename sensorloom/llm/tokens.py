"""Token counts: rank-synchronous merging of ragged arrays of pre-tokens.

A text is normalised (dummy prefix, spaces to U+2581), cut into pre-tokens where no vocabulary
piece can cross, and each distinct pre-token of a batch becomes one row of a ragged numpy array.
In every round each row applies its lowest-rank pair, all rows at once; the symbols that survive
are counted, characters outside the vocabulary as their UTF-8 bytes.

Edge cases: a null or empty text has 0 tokens; repeated rows give repeated results; other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sensorloom.llm.common import text_chunks

MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Distinct pre-tokens remembered by a worker, and the longest one remembered.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48
#: Rows that must merge one pair at a time use a heap from this many symbols on.
LONG_ROW = 2048


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTable:
    """Vocabulary of a byte-fallback BPE model as sorted arrays of mergeable pairs."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = {}
        for i in range(sp.vocab_size()):
            if sp.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
                pieces[sp.id_to_piece(i)] = sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece spans words; texts cannot be cut before words")
        symbols = list(pieces) + sorted({c for p in pieces for c in p} - set(pieces))
        index = {s: i for i, s in enumerate(symbols)}
        scores = sorted({-x for x in pieces.values()})
        order = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(len(symbols), NONE, dtype=np.int32)
        self.rank[: len(pieces)] = [order[-x] for x in pieces.values()]
        counts = np.bincount(self.rank[: len(pieces)], minlength=len(scores))
        self.shared = counts > 1  # ranks that several pieces have
        self.size = len(symbols) + 1  # the last symbol: a character of no piece
        pairs = {}
        for p in pieces:
            for k in range(1, len(p)):
                a, b = index.get(p[:k]), index.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = index[p]
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        self.n_pieces = len(pieces)
        chars = sorted((ord(s), i) for s, i in index.items() if len(s) == 1)
        self.points = np.array([c for c, _ in chars], dtype=np.uint32)
        self.point_ids = np.array([i for _, i in chars], dtype=np.int32)
        crossing = {c for p in pieces if len(p) > 1 for c in p}
        alone = "" if "\n" in crossing else r"\n"
        self.cut = re.compile(rf"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + ("|\n" if alone else "")).findall

    def pair_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged symbol of each pair, or -1."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def symbols(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, row number and token cost of every character of ``rows``."""
        points = np.frombuffer("".join(rows).encode("utf-32-le"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        sym = np.where(self.points[at] == points, self.point_ids[at], self.size - 1).astype(np.int32)
        n_bytes = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
        cost = np.where(sym < self.n_pieces, 1, n_bytes).astype(np.int32)
        return sym, np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), cost

    def count(self, rows: list[str]) -> np.ndarray:
        """Number of tokens of each row."""
        counts = np.zeros(len(rows), dtype=np.int64)
        again = self._merge(rows, counts, one_by_one=False)
        if again:
            again.sort()
            long = [i for i in again if len(rows[i]) >= LONG_ROW]
            for i in long:
                counts[i] = self._heap(rows[i])
            short = [i for i in again if len(rows[i]) < LONG_ROW]
            own = np.zeros(len(short), dtype=np.int64)
            if short:
                self._merge([rows[i] for i in short], own, one_by_one=True)
                counts[short] = own
        return counts

    def _merge(self, rows: list[str], counts: np.ndarray, one_by_one: bool) -> list[int]:
        """Merge all rows in step.  Returns rows where merging several equal pairs at once met a
        pair of lower or equal rank afterwards, so that the order of merges could matter."""
        sym, row, cost = self.symbols(rows)
        before = np.full(len(rows), -1, dtype=np.int64)  # rank of the last round if it merged several pairs
        again: list[int] = []
        while len(sym):
            heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            into = np.full(len(sym), -1, dtype=np.int32)
            into[:-1] = np.where(row[1:] == row[:-1], self.pair_of(sym[:-1], sym[1:]), -1)
            rank = np.where(into >= 0, self.rank[into], NONE)
            best = np.minimum.reduceat(rank, heads)
            ids, sizes = row[heads], np.diff(np.r_[heads, len(sym)])
            unsafe = best <= before[ids]
            again += ids[unsafe].tolist()
            done = (best == NONE) & ~unsafe
            counts[ids[done]] = np.add.reduceat(cost, heads)[done]
            drop = np.repeat(done | unsafe, sizes)
            chosen = (rank == np.repeat(best, sizes)) & ~drop
            at = np.flatnonzero(chosen)
            if len(at) == 0:
                break
            first = np.r_[True, row[at[1:]] != row[at[:-1]]]
            if one_by_one:
                at = at[first]
            else:
                run = np.r_[True, at[1:] != at[:-1] + 1] | first  # of neighbouring pairs every other one merges
                lead = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
                keep = ((at - lead) % 2 == 0) & (first | ~self.shared[rank[at]])
                at = at[keep]
                n = np.bincount(row[at], minlength=len(rows))
                before = np.full(len(rows), -1, dtype=np.int64)
                several = n[row[at]] > 1
                before[row[at[several]]] = rank[at[several]]
            sym[at], cost[at] = into[at], 1
            drop[at + 1] = True
            sym, row, cost = sym[~drop], row[~drop], cost[~drop]
        return again

    def _heap(self, text: str) -> int:
        """The same merges for one long row, one pair at a time by rank, then place."""
        sym, _, cost = (x.tolist() for x in self.symbols([text]))
        n = len(sym)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        version = [0] * n
        table = dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True))
        rank = self.rank.tolist()
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if 0 <= i else n
            if 0 <= i and j < n:
                m = table.get(sym[i] * self.size + sym[j])
                if m is not None:
                    heapq.heappush(heap, (rank[m], i, m, version[i], version[j]))

        for i in range(n - 1):
            offer(i)
        alive = [True] * n
        while heap:
            _, i, m, vi, vj = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or version[i] != vi or j >= n or version[j] != vj:
                continue
            sym[i], cost[i], alive[j] = m, 1, False
            version[i] += 1
            version[j] += 1
            after[i] = after[j]
            if after[i] < n:
                prior[after[i]] = i
            offer(prior[i])
            offer(i)
        return sum(c for c, a in zip(cost, alive, strict=True) if a)


@lru_cache(maxsize=2)
def piece_table(model_file: str) -> PieceTable:
    return PieceTable(model_file)


def count_texts(texts: list[str], table: PieceTable, memo: dict[str, int]) -> list[int]:
    cut = [table.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    new = {p for parts in cut for p in parts if p not in memo}
    if len(memo) + len(new) > MEMO_ENTRIES:
        memo.clear()
        new = {p for parts in cut for p in parts}
    own = memo
    if new:
        rows = sorted(new)
        counts = table.count(rows).tolist()
        memo.update((p, c) for p, c in zip(rows, counts, strict=True) if len(p) <= MEMO_CHARS)
        long = {p: c for p, c in zip(rows, counts, strict=True) if len(p) > MEMO_CHARS}
        if long:
            return [sum(long[p] if p in long else memo[p] for p in parts) for parts in cut]
    return [sum(map(own.__getitem__, parts)) for parts in cut]


def token_counts(docs: DataFrame, model_file: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens`` for every row of ``docs``."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(model_file or default_model())
        memo: dict[str, int] = {}
        for batch in batches:
            for lo, hi in text_chunks(batch, "t"):
                texts = [t or "" for t in batch.column("t").slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("i").slice(lo, hi - lo), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(count_texts(texts, pieces, memo), pa.int64())],
                    [id_col, "n_bytes", "n_tokens"],
                )

    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, schema)
