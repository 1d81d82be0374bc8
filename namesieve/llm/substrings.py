"""Substring dedup with a count-min prefilter.

First pass: every partition sketches the keys of its windows; the merged sketch overestimates how
often a window occurs and never underestimates it.  Second pass: only windows estimated twice or more
travel, as runs that hold their words, and are grouped exactly.  A final join by document cuts the
words that repeated windows cover; windows are judged on the input.

Hot windows: equal runs of one slice are merged before the shuffle, and keys that the sketch finds
very frequent are split into their single windows, each with a key of its own.

Defined results: a null or blank text has no words; a text shorter than a window keeps all; repeated
rows count as occurrences; rows with null or repeated ids are told apart by their text; an empty table
gives no rows; very long texts are one slice; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.llm.chunks import gather, lean, slices
from namesieve.llm.windows import (
    BASES, Hasher, Sketch, anchors, covered, merged_sketch, mix, spans_of, symbol_table, whole_groups, window_runs,
)

WORDS = 35
GRAM = 8
SLICE = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
TABLE = symbol_table(10)


class Words:
    """Words of a slice of texts: byte ranges, hashes, and each text's first word."""

    def __init__(self, texts: pa.Array):
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), " ")[0]
        self.data = np.frombuffer(joined.as_buffer(), np.uint8) if joined.as_buffer() else np.zeros(0, np.uint8)
        blank = BLANK[self.data]
        word = np.flatnonzero(~blank)
        edge = np.diff(word, prepend=-2) > 1
        self.begin = word[edge]
        self.end = np.append(word[np.flatnonzero(edge)[1:] - 1], word[-1:]) + 1 if len(word) else word
        text_at = np.append(np.cumsum(sizes + 1) - sizes - 1, len(self.data) + 1)
        self.starts = np.searchsorted(self.begin, text_at)
        self.hashes = Hasher(TABLE[self.data]).ranges(self.begin, self.end)


def _key_arrays(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            words = Words(part.column("text"))
            yield anchors(words.hashes, words.starts, length, GRAM)


def candidate_runs(part: pa.RecordBatch, sketch: Sketch, length: int) -> pa.RecordBatch:
    """Runs whose windows may be repeated: key, doc, tid, start, n, copies, words.

    Equal runs of the slice are merged: the first holds ``copies`` and the words, the others have
    copies 0 and no words, and are known to be repeated.
    """
    words = Words(part.column("text"))
    tids = part.column("tid").to_numpy().astype(np.int64).view(np.uint64)
    keys, first, count = window_runs(words.hashes, words.starts, length, GRAM)
    keep = sketch.repeated(keys)
    keys, first, count = keys[keep], first[keep], count[keep]
    hot = sketch.frequent(keys)
    hasher = Hasher(words.hashes)
    if hot.any():
        # Single windows, keyed by themselves.
        single = gather(np.arange(len(words.hashes)), first[hot], count[hot])
        own = hasher.ranges(single, single + length)
        keys = np.concatenate([keys[~hot], own])
        first = np.concatenate([first[~hot], single])
        count = np.concatenate([count[~hot], np.ones(len(single), np.int64)])
    content = hasher.ranges(first, first + count + length - 1)
    order = np.lexsort((first, content, keys))
    keys, first, count, content = keys[order], first[order], count[order], content[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (content[1:] != content[:-1])
    copies = np.zeros(len(keys), np.int64)
    copies[new] = np.diff(np.append(np.flatnonzero(new), len(keys)))
    doc = np.searchsorted(words.starts, first, side="right") - 1
    # Rows without words need no group: they spread over all tasks.
    keys = np.where(new, keys, mix(first.astype(np.uint64) ^ content ^ tids[doc]))
    begin = words.begin[first]
    size = np.where(new, words.end[first + count + length - 2] - begin, 0) if len(first) else first
    data = gather(words.data, begin, size)
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    blobs = pa.BinaryArray.from_buffers(
        pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    )
    at = pa.array(doc)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys.view(np.int64)), part.column("doc").take(at), part.column("tid").take(at),
            pa.array((first - words.starts[doc]).astype(np.int32)), pa.array(count.astype(np.int32)),
            pa.array(copies.astype(np.int32)), blobs,
        ],
        ["key", "doc", "tid", "start", "n", "copies", "words"],
    )


def repeated_spans(table: pa.Table, length: int) -> pa.RecordBatch:
    """Covered word ranges of whole key groups, by exact counts of their windows."""
    table = table.combine_chunks()
    copies = table.column("copies").to_numpy().astype(np.int64)
    keys = table.column("key").to_numpy()
    count = table.column("n").to_numpy().astype(np.int64)
    start = table.column("start").to_numpy().astype(np.int64)
    blobs = table.column("words").combine_chunks()
    words = Words(pc.cast(blobs, pa.string()))
    # Windows of the rows with words; two independent hashes stand for 35 words.
    row = np.repeat(np.arange(len(keys)), np.where(copies > 0, count, 0))
    place = np.arange(len(row)) - np.searchsorted(row, row)
    at = words.starts[row] + place
    one = Hasher(words.hashes).ranges(at, at + length)
    two = Hasher(words.hashes, BASES[1]).ranges(at, at + length)
    order = np.lexsort((two, one))
    one, two, weight = one[order], two[order], copies[row][order]
    group = np.cumsum(np.append(False, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(one) else one
    total = np.bincount(group.astype(np.int64), weights=weight) if len(one) else np.zeros(0)
    flags = np.zeros(len(row), bool)
    flags[order] = total[group.astype(np.int64)] >= 2 if len(one) else False
    owner, begin, size = spans_of(flags, row, start[row] + place, length)
    # Rows merged into another of their slice are repeated as they stand.
    merged = np.flatnonzero(copies == 0)
    owner = np.concatenate([owner, merged])
    begin = np.concatenate([begin, start[merged]])
    size = np.concatenate([size, count[merged] + length - 1])
    take = pa.array(owner)
    return pa.RecordBatch.from_arrays(
        [
            table.column("doc").combine_chunks().take(take), table.column("tid").combine_chunks().take(take),
            pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32)),
        ],
        ["doc", "tid", "start", "length"],
    )


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = WORDS) -> DataFrame:
    """Word ranges covered by windows that occur twice or more: doc, tid, start, length (may overlap)."""
    rows = _rows(docs, key, text, F.xxhash64)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = rows.select("text")
    sketch = merged_sketch(texts, lambda b: _key_arrays(b, length), size / 80)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    kind = rows.schema["doc"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield candidate_runs(part, shared.value, length)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            yield repeated_spans(table, length)

    runs = rows.mapInArrow(
        lean(emit), f"key long, doc {kind}, tid long, start int, n int, copies int, words binary"
    )
    return runs.repartition("key").sortWithinPartitions("key").mapInArrow(
        lean(group), f"doc {kind}, tid long, start int, length int"
    )


def _rows(docs: DataFrame, key: str, text: str, tid=F.hash) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("tid", tid("text"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with their spans as one array; bounded by the length of a text."""
    spans = spans.groupBy(F.col("doc").alias("_doc"), F.col("tid").alias("_tid")).agg(
        F.collect_list(F.struct("start", "length")).alias("spans")
    )
    match = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tid") == F.col("_tid"))
    return rows.join(spans, match, "left").select("doc", "tid", "text", "spans")


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = WORDS
) -> DataFrame:
    """Per document: ``key, n_words, n_removed, kept_sha256, kept_text`` (kept words, single spaces)."""
    return removed_rows(docs, key, text, length).drop("tid")


def removed_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = WORDS
) -> DataFrame:
    """What :func:`remove_repeats` returns, with ``tid``, the hash of the text (a null text is empty)."""
    rows = _rows(docs, key, text, F.xxhash64)
    joined = with_spans(rows, repeated_windows(docs, key, text, length))
    kind = rows.schema["doc"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n, removed, kept = [], [], []
                for body, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    words = pa_words(body)
                    gone = covered(spans, len(words))
                    n.append(len(words))
                    removed.append(int(gone.sum()))
                    kept.append(" ".join(w for w, g in zip(words, gone.tolist()) if not g) if spans else " ".join(words))
                sha = [hashlib.sha256(k.encode()).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("tid"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept)],
                    ["doc", "tid", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    result = joined.mapInArrow(
        lean(cut), f"doc {kind}, tid long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
    return result.withColumnRenamed("doc", key)


def pa_words(text: str) -> list[str]:
    """Words between the six ASCII blanks; ``str.split`` alone would cut at other blanks too."""
    return [w for w in text.translate(_TO_SPACE).split(" ") if w]


_TO_SPACE = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}
