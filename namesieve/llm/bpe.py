"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

The lowest-rank adjacent pair is popped from a heap until none is left; the count of a piece is its
initial symbols less the merges.  Symbols are linked in both directions, so a merge is O(log n) and
a piece of any length takes O(n log n).

Defined results: null and empty texts count 0; special strings inside a text are one token each, as
the library treats them by default; equal texts get equal counts; an empty table gives no rows; the
result has only the named columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.llm.chunks import chunked, slices, split_tails, sums, uncut

# Fixed value: the pattern that splits text before byte-level merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES = 800_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = dict(zip(shown, map(chr, shown))) | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class MergeCounter:
    """Counts tokens of pieces for one vocabulary file; keeps a bounded cache of pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Symbols are numbers, the bytes first; a merge's number also is its rank, from 256 on.
        ids = {symbol: b for b, symbol in enumerate(byte_symbols())}
        self.ranks: dict[int, int] = {}
        for i, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            rank = ids[left + right] = 256 + i
            self.ranks[ids[left] << 20 | ids[right]] = rank
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.cache: dict[str, int] = {}

    def merge(self, piece: str) -> int:
        """Tokens of one piece."""
        symbols = list(piece.encode("utf-8"))
        n, rank_of = len(symbols), self.ranks.get
        # Rank of the pair that begins at each place (0: none): an entry of the heap whose rank is
        # no longer there is stale.
        pairs = [rank_of(a << 20 | b, 0) for a, b in zip(symbols, symbols[1:])]
        pairs.append(0)
        heap = [r << 32 | i for i, r in enumerate(pairs) if r]
        if not heap:
            return n
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = 0
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            if pairs[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            symbols[i], pairs[j] = rank, 0
            merges += 1
            if k < n:
                before[k] = i
                pairs[i] = r = rank_of(rank << 20 | symbols[k], 0)
                if r:
                    heappush(heap, r << 32 | i)
            else:
                pairs[i] = 0
            h = before[i]
            if h >= 0:
                pairs[h] = r = rank_of(symbols[h] << 20 | rank, 0)
                if r:
                    heappush(heap, r << 32 | h)
        return n - merges

    def piece(self, piece: str) -> int:
        """Tokens of one piece, from the cache if it is short."""
        n = self.cache.get(piece)
        if n is None:
            n = self.merge(piece)
            if len(piece) <= 64:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        return sum(map(self.piece, self.pieces.findall(text)))

    def count(self, text: str) -> int:
        """Tokens of a text, special strings included, however many there are."""
        total, at = 0, 0
        for found in self.special.finditer(text) if self.special else ():
            total += self.plain(text[at : found.start()]) + 1
            at = found.end()
        return total + self.plain(text[at:])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; equal chunks are counted once."""
        whole = uncut(texts)
        distinct, codes, starts = chunked(pc.if_else(pa.array(whole), "", texts))
        stems, stem_of, tails, tail_of = split_tails(distinct)
        known = (self.piece(" " + c) if c.isalpha() else self.count(" " + c) for c in stems)
        closing = np.array([self.count(t) for t in tails], np.int64)
        each = np.fromiter(known, np.int64, len(stems))[stem_of] + closing[tail_of]
        first = codes[starts[:-1]]
        heads = {c: self.count(distinct[int(c)].as_py()) for c in np.unique(first)}
        result = sums(each[codes], starts) - each[first]
        result += np.fromiter((heads[c] for c in first), np.int64, len(first))
        for i in np.flatnonzero(whole):
            result[i] = self.count(texts[int(i)].as_py())
        return result


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens`` of every row; narrow, without an exchange.

    ``path`` is the vocabulary file, present under the same path on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                size = pc.binary_length(texts).cast("int64")
                tokens = pa.array(merges.counts(texts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), size, tokens], ["key", "n_bytes", "n_tokens"]
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return counted.withColumnRenamed("key", key)
