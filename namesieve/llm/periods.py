"""Runs of periodically repeated words, through a dictionary of basic factors.

For each power of two L the factors of L words are named, equal names for equal factors.  Places of
one name that follow within L / 2 words lie in an arithmetic progression, a cluster; its step is a
period of the factor.  The distances between the places of two clusters less than 2 L apart form an
arithmetic progression too, and every run whose period is in [L, 2 L) repeats a factor of L words at
one of them: these distances are the proposed periods.  Each proposal is extended to both sides by
the names of all levels, equal stretches are made one, and the least period of a stretch is its own.

A slice of texts is worked on as one array; words are named within their text, so no factor is
common to two texts.  Places whose factor stands only once are dropped from level to level.  The
memory of a task is about 4 bytes x words x levels of one slice, which holds one whole text at least.

Defined results: null, empty and blank texts have no words and no runs; words are compared as
bytes; repeated rows get equal results; an empty table gives no rows; a null id keeps its text as it
is; the results have the named columns only.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.llm.chunks import slices

SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class RunRules:
    """A run has ``min_length`` words at least and ``min_repeats`` periods (2 or more)."""

    min_length: int = 12
    min_repeats: int = 2

    def first_level(self) -> int:
        """The longest factor that every run of a period below twice its length repeats."""
        level = 0
        while 3 * (2 << level) - 1 <= self.min_length:
            level += 1
        return level


def rename(keys: np.ndarray) -> np.ndarray:
    """Dense names of equal keys; -1 for keys that stand only once."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    group = np.cumsum(starts) - 1
    group[np.bincount(group)[group] == 1] = -1
    names = np.empty(len(keys), np.int32)
    names[order] = group
    return names


class Factors:
    """Names of the factors of 1, 2, 4 ... words; -1 where a factor is unique or ends outside."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        """``words`` are codes of words, ``ends`` the place behind the last word of each word's text."""
        vocabulary = int(words.max(initial=0)) + 1
        first = rename(ends.astype(np.int64) * vocabulary + words) if len(words) else words.astype(np.int32)
        self.ends, self.levels = ends, [first]
        while len(words):
            more = self._longer()
            if more is None:
                break
            self.levels.append(more)

    def _longer(self) -> np.ndarray | None:
        names, size = self.levels[-1], 1 << (len(self.levels) - 1)
        at = np.flatnonzero(names[: max(len(names) - size, 0)] >= 0)
        at = at[(names[at + size] >= 0) & (at + 2 * size <= self.ends[at])]
        if not len(at):
            return None
        pairs = rename(names[at].astype(np.int64) << 32 | names[at + size])
        longer = np.full(len(names), -1, np.int32)
        longer[at] = pairs
        return longer if (pairs >= 0).any() else None

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from ``x`` on equal those from ``y`` on."""
        total, length = len(self.ends), np.zeros(len(x), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names = self.levels[level]
            a, b = x + length, y + length
            inside = b < total
            a, b = np.where(inside, a, 0), np.where(inside, b, 0)
            length += np.where(inside & (names[a] >= 0) & (names[a] == names[b]), 1 << level, 0)
        return length

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before ``x`` equal those before ``y``."""
        length = np.zeros(len(x), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[level], 1 << level
            a, b = x - length - size, y - length - size
            inside = a >= 0
            a, b = np.where(inside, a, 0), np.where(inside, b, 0)
            length += np.where(inside & (names[a] >= 0) & (names[a] == names[b]), size, 0)
        return length

    def proposals(self, level: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """A place and a period from ``least`` to 2 L - 1 for each distance between clusters."""
        names, size = self.levels[level], 1 << level
        at = np.flatnonzero(names >= 0)
        at = at[np.argsort(names[at], kind="stable")]
        if len(at) < 2:
            return at[:0], at[:0]
        gaps, same = np.diff(at), np.diff(names[at]) == 0
        linked = same & (gaps <= size // 2)
        # Clusters: first and last place, places in them, their step.
        begins = np.flatnonzero(np.concatenate(([True], ~linked)))
        sizes = np.diff(np.append(begins, len(at)))
        first, last, name = at[begins], at[begins + sizes - 1], names[at[begins]]
        inner = sizes > 1
        step = np.zeros(len(begins), np.int64)
        step[inner] = gaps[begins[inner]]
        places, periods = [first[inner & (step >= least)]], [step[inner & (step >= least)]]
        # Clusters of a name are more than L / 2 apart, so those within 2 L are among the next four.
        for ahead in range(1, 5):
            a, b = np.arange(max(len(begins) - ahead, 0)), np.arange(ahead, len(begins))
            near = (name[a] == name[b]) & (first[b] - last[a] < 2 * size)
            a, b = a[near], b[near]
            if not len(a):
                break
            stride = np.maximum(np.maximum(step[a], step[b]), 1)
            lowest = first[b] - last[a]
            steps = np.minimum(sizes[a] + sizes[b] - 2, (2 * size - 1 - lowest) // stride)
            skipped = np.maximum(-(-(least - lowest) // stride), 0)
            count = np.maximum(steps - skipped + 1, 0)
            turn = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            turn += np.repeat(skipped, count)
            back = np.minimum(turn, np.repeat(sizes[a] - 1, count))
            places.append(np.repeat(last[a], count) - back * np.repeat(stride, count))
            periods.append(np.repeat(lowest, count) + turn * np.repeat(stride, count))
        return np.concatenate(places), np.concatenate(periods)


def find_runs(words: np.ndarray, ends: np.ndarray, rules: RunRules = RunRules()) -> np.ndarray:
    """``start, length, period`` of all runs, by start, then period; places count over all texts."""
    factors, found = Factors(words, ends), []
    lowest = rules.first_level()
    for level in range(lowest, len(factors.levels)):
        x, period = factors.proposals(level, 1 if level == lowest else 1 << level)
        y = x + period
        start = x - factors.backward(x, y)
        length = y + factors.forward(x, y) - start
        good = length >= np.maximum(rules.min_length, rules.min_repeats * period)
        found.append(np.unique(np.stack([start[good], length[good], period[good]], axis=1), axis=0))
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # The least period of a stretch; others of the same stretch are its multiples.
    new = np.concatenate(([True], (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)))[: len(rows)]
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def plant(doc_id: object, words: list[bytes]) -> list[bytes]:
    """Words of the contract's tenth of documents, one part of them repeated with a period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


RESULT = (
    "key {kind}, n_words long, n_runs long, start long, length long, period long, "
    "runs array<struct<start: long, length: long, period: long>>, kept string"
)


def _texts(part: pa.RecordBatch, prepare: Callable[[object, list[bytes]], list[bytes]] | None) -> list[list[bytes]]:
    texts = part.column("text").cast(pa.binary()).to_pylist()
    # bytes.split() splits at the six blanks of ASCII only.
    words = [(t or b"").split() for t in texts]
    if prepare is not None:
        words = [prepare(k, w) for k, w in zip(part.column("key").to_pylist(), words)]
    return words


def _judge(part: pa.RecordBatch, prepare, rules: RunRules) -> pa.RecordBatch:
    words = _texts(part, prepare)
    sizes = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(sizes) - sizes
    flat = [w for each in words for w in each]
    codes = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    runs = find_runs(codes, np.repeat(begins + sizes, sizes), rules)
    owner = np.searchsorted(begins + sizes, runs[:, 0], side="right")
    bounds = np.searchsorted(owner, np.arange(len(words) + 1))
    # Words behind the first period of any run, as +1 and -1 at its ends.
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(change)[:-1] > 0
    top, lists, kept = [], [], []
    for i, each in enumerate(words):
        own = runs[bounds[i] : bounds[i + 1]] - [begins[i], 0, 0]
        lists.append([dict(zip(("start", "length", "period"), r)) for r in own.tolist()])
        best = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist() if len(own) else [None] * 3
        top.append(best)
        if len(own):
            gone = dropped[begins[i] : begins[i] + sizes[i]].tolist()
            each = [w for w, d in zip(each, gone) if not d]
        kept.append(b" ".join(each))
    start, length, period = zip(*top) if top else ((), (), ())
    columns = [
        part.column("key"), pa.array(sizes), pa.array([len(r) for r in lists], pa.int64()),
        *(pa.array(c, pa.int64()) for c in (start, length, period)),
        pa.array(lists, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
        pa.array(kept, pa.binary()).cast(pa.string()),
    ]
    names = ["key", "n_words", "n_runs", "start", "length", "period", "runs", "kept"]
    return pa.RecordBatch.from_arrays(columns, names)


def periodic_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rules: RunRules = RunRules(),
    prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``key``, words, number of runs, the longest run, all ``runs`` and the text ``kept``; no exchange.

    ``kept`` are the words that lie in no run behind its first period, joined by one space.
    ``prepare`` may change the words of a document before the search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield _judge(part, prepare, rules)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, RESULT.format(kind=kind)).withColumnRenamed("key", key)


def runs_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the contract from ``periodic_runs``."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        key, "n_words", "n_runs", "start", "length", "period",
        F.expr("1000 * length div period").cast("long").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("kept", "UTF-8"), 256).alias("collapsed_sha256"),
    )
