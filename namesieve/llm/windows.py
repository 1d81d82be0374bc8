"""Array helpers of the two window operators: range hashes, window keys, sketches, group streams.

A window of ``length`` symbols is keyed by the least mixed hash of the grams inside it, so equal
windows have equal keys wherever they stand, and neighbouring windows mostly share theirs.  A run of
neighbours with one key travels as one row that holds all their symbols.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.llm.chunks import lean

BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
LONGEST_RUN = 256
BLOCK = 1 << 16
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def symbol_table(seed: int) -> np.ndarray:
    """A random 64-bit value per byte."""
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        have = _powers[base] = (both[0], both[1])
        if size > 1 << 24:
            _powers.pop(base)  # a single very long text: not kept
    return have[0][:n], have[1][:n]


class Hasher:
    """Hash of any range of a symbol array in constant time."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        power, self.inverse = _power(base, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * power[:-1], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all ranges of one width."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:-width]) * self.inverse[:n] if n > 0 else self.sums[:0]

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    if len(values) < width:
        return values[:0]
    done, size = values, 1
    while size * 2 <= width:
        done = np.minimum(done[:-size], done[size:])
        size *= 2
    rest = width - size
    return np.minimum(done[: len(done) - rest], done[rest:]) if rest else done


def window_runs(
    symbols: np.ndarray, starts: np.ndarray, length: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first windows and numbers of windows of all runs.

    ``starts`` are the texts' first symbols, with the end.  Windows never cross texts.
    """
    empty = np.zeros(0, np.int64)
    if len(symbols) < length:
        return empty.astype(np.uint64), empty, empty
    keys = least(mix(Hasher(symbols).every(gram)), length - gram + 1)
    n = len(keys)
    # Windows that begin less than ``length`` symbols before their text's end do not exist.
    valid = np.zeros(n + 1, np.int64)
    sizes = np.diff(starts)
    longer = sizes >= length
    np.add.at(valid, starts[:-1][longer], 1)
    np.add.at(valid, starts[1:][longer] - length + 1, -1)
    ok = np.cumsum(valid[:-1]) > 0
    fresh = np.ones(n, bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | ~ok[:-1]
    inside = starts[1:-1]
    fresh[inside[inside < n]] = True
    first = np.flatnonzero(fresh & ok)
    # A run ends at the next fresh or missing window.
    stop = np.flatnonzero(np.append(fresh | ~ok, True))
    count = stop[np.searchsorted(stop, first, side="right")] - first
    if len(count) and count.max() > LONGEST_RUN:
        pieces = -(-count // LONGEST_RUN)
        base = np.repeat(first, pieces)
        step = np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end = np.repeat(first + count, pieces)
        first = base + step * LONGEST_RUN
        count = np.minimum(end - first, LONGEST_RUN)
    return keys[first], first, count


def anchors(symbols: np.ndarray, starts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Keys of all windows, once for each place where the gram of the key stands.

    Two equal windows have their grams in different places, also if they overlap, so a repeated
    window's key comes at least twice.
    """
    if len(symbols) < length:
        return np.zeros(0, np.uint64)
    grams = mix(Hasher(symbols).every(gram))
    width = length - gram + 1
    keys = least(grams, width)
    exists = np.zeros(len(keys) + 1, np.int64)
    longer = np.diff(starts) >= length
    np.add.at(exists, starts[:-1][longer], 1)
    np.add.at(exists, starts[1:][longer] - length + 1, -1)
    keys = np.where(np.cumsum(exists[:-1]) > 0, keys, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    # A gram is some window's key if it equals the largest key of the windows that hold it.
    most = ~least(~np.concatenate([pad, keys, pad]), width)
    return grams[grams == most]


class Sketch:
    """What the merged count-min sketch says about keys: seen once, repeated, or very frequent."""

    ROWS = 2

    def __init__(self, bits: int, repeated: list[tuple[int, bytes]], hot: list[int]):
        self.bits, self.blocks = bits, repeated
        self.hot = np.array(sorted(hot), np.int64)
        self.map: np.ndarray | None = None

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
        """Counter of each key in each row; rows lie one after the other."""
        spread = mix(keys ^ np.uint64(0x5851F42D4C957F2D))
        low = (spread & np.uint64((1 << bits) - 1)).astype(np.int64)
        high = (spread >> np.uint64(64 - bits)).astype(np.int64)
        return [low, high + (1 << bits)]

    def _read(self) -> np.ndarray:
        if self.map is None:
            self.map = np.zeros(Sketch.ROWS << self.bits >> 3, np.uint8)
            for block, data in self.blocks:
                at = block * (BLOCK >> 3)
                self.map[at : at + (BLOCK >> 3)] = np.frombuffer(zlib.decompress(data), np.uint8)
            self.blocks = []
        return self.map

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Whether the estimate of each key is two or more; never false for a repeated key."""
        bitmap = self._read()
        found = np.ones(len(keys), bool)
        for at in self.places(keys, self.bits):
            found &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return found

    def frequent(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), bool(len(self.hot)))
        for at in self.places(keys, self.bits) if len(self.hot) else ():
            found &= np.isin(at, self.hot)
        return found


def merged_sketch(rows: DataFrame, key_arrays, expected_keys: float, hot_share: float = 1 / 65_536) -> Sketch:
    """Merge the sparse sketches of all partitions, block by block, into one.

    ``key_arrays`` maps the Arrow batches of a partition to arrays of keys.  The sketch has about five
    counters for an expected key, at most 2 ** 28 in a row: what the driver gathers and broadcasts is
    two bits per counter and bounded by that (64 MB).  A fuller sketch passes more
    keys on to the exact pass and never loses one.
    """
    bits = int(np.clip(np.ceil(np.log2(max(1.0, 2.5 * expected_keys))), 16, 28))
    hot_at = max(2_000, int(expected_keys * hot_share))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            at = np.concatenate([x for keys in waiting for x in Sketch.places(keys, bits)])
            at, n = np.unique(at, return_counts=True)
            block = at // BLOCK
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            ends = [*cut[1:], len(at)]
            # Gaps between a block's counters are mostly below 256, so their upper bytes compress away.
            gap = np.diff(at, prepend=0)
            gap[cut] = at[cut] % BLOCK
            n = np.minimum(n, 65_535)
            pairs = [(planes(gap[a:b]), planes(n[a:b]) if (n[a:b] > 1).any() else b"") for a, b in zip(cut, ends)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(block[cut], pa.int32()),
                    pa.array([p[0] for p in pairs], pa.binary()),
                    pa.array([p[1] for p in pairs], pa.binary()),
                ],
                ["block", "at", "n"],
            )

        for keys in key_arrays(batches):
            waiting.append(keys)
            size += len(keys)
            if size >= 2_000_000:
                yield flush()
                waiting, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "block", 1):
            blocks = table.column("block").to_numpy()
            for block in np.unique(blocks):
                own = table.filter(pa.array(blocks == block))
                total = np.zeros(BLOCK, np.int64)
                for at, n in zip(own.column("at").to_pylist(), own.column("n").to_pylist()):
                    total[np.cumsum(from_planes(at))] += from_planes(n) if n else 1
                hot = np.flatnonzero(total >= hot_at) + int(block) * BLOCK
                packed = zlib.compress(np.packbits(total >= 2, bitorder="little").tobytes(), 1) if (total >= 2).any() else b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([packed]), pa.array([hot.tolist()], pa.list_(pa.int64()))],
                    ["block", "repeated", "hot"],
                )

    sparse = rows.mapInArrow(lean(partial), "block int, at binary, n binary")
    merged = sparse.repartition("block").sortWithinPartitions("block").mapInArrow(
        lean(merge), "block int, repeated binary, hot array<long>"
    )
    found = merged.collect()
    return Sketch(
        bits,
        [(r["block"], bytes(r["repeated"])) for r in found if r["repeated"]],
        [h for r in found for h in r["hot"]],
    )


def planes(values: np.ndarray) -> bytes:
    """Numbers below 65,536: all lower bytes, then all upper bytes."""
    return (values & 255).astype(np.uint8).tobytes() + (values >> 8).astype(np.uint8).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(data, np.uint8).reshape(2, -1).astype(np.int64)
    return low + (high << 8)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 30_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that hold whole groups of a stream sorted by ``key``."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        keys = batch.column(key)
        before = keys.slice(0, len(keys) - 1)
        last = keys[len(keys) - 1]
        other = np.flatnonzero(np.array(before) != last.as_py()) if len(before) else []
        if len(other):
            cut = int(other[-1]) + 1
        elif len(waiting) > 1 and waiting[-2].column(key)[-1].as_py() != last.as_py():
            cut = 0
        else:
            continue  # the whole batch is one group that began earlier or goes on
        head = [*waiting[:-1], *([batch.slice(0, cut)] if cut else [])]
        if head:
            yield pa.Table.from_batches(head)
        waiting = [batch.slice(cut)]
        size = waiting[0].num_rows
    if waiting:
        yield pa.Table.from_batches(waiting)


def spans_of(flags: np.ndarray, owner: np.ndarray, at: np.ndarray, length: int):
    """Covered ranges of flagged windows: owner, first symbol, number of symbols.

    Windows are given by owner and position, ascending within an owner.
    """
    i = np.flatnonzero(flags)
    if not len(i):
        return i, i, i
    owner, at = owner[i], at[i]
    new = np.ones(len(i), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    return owner[first], at[first], at[last] + length - at[first]


def covered(spans: list[dict] | None, size: int) -> np.ndarray:
    """Mask of the symbols that the spans cover."""
    edge = np.zeros(size + 1, np.int64)
    if spans:
        begin = np.fromiter((s["start"] for s in spans), np.int64, len(spans))
        end = begin + np.fromiter((s["length"] for s in spans), np.int64, len(spans))
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0
