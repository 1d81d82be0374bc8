"""Exact substring dedup by prefix-free parsing.

Rolling hashes choose triggers: in every ``length`` bytes the gram of least mixed hash.  Windows that
share a trigger form a phrase, which reaches ``length - 1`` bytes into the next, so no phrase is a
proper prefix of another's occurrence and every ``length``-byte string lies inside one phrase.  The
dictionary holds distinct phrases; the parse says in which documents each stands.  Per trigger the
suffixes of the dictionary's phrases are sorted to the depth ``length`` and meet the parse there: the
smallest document of each run of equal suffixes decides which occurrences go.  Highly repetitive text
has few phrases, so the sorted part stays small however often they occur.

A sketch of the triggers leaves out phrases whose trigger stands once in the corpus; it loses none.
Equal phrases of a slice are merged before the shuffle, and phrases of very frequent triggers are
split into their windows.  Phrases travel compressed, a block for each bucket of triggers; the number
of buckets grows with the input, so a bucket's size does not.

Defined results: matches never cross documents; a null text is empty; shorter texts keep all bytes;
a match inside one document alone removes nothing; rows of equal id count as one document and are
told apart by their text; a null id is larger than any other; empty table: no rows; extra columns are
left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.llm.chunks import gather, slices
from namesieve.llm.substrings import _rows, with_spans
from namesieve.llm.windows import (
    Hasher, Sketch, covered, merged_sketch, mix, spans_of, symbol_table, window_runs,
)

BYTES = 50
GRAM = 24
SLICE = 2 << 20
TABLE = symbol_table(8)
LAST = np.iinfo(np.int64).max
BUCKET_BYTES = 3 << 20  # text for each bucket, whose phrases are about 128,000 at most
FLUSH_ROWS = 200_000
GROUP_ROWS = 30_000
PARSE = pa.schema(
    [
        ("key", pa.int64()), ("doc", pa.int64()), ("tid", pa.int32()), ("start", pa.int32()),
        ("n", pa.int32()), ("cut", pa.int32()), ("phrase", pa.binary()),
    ]
)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after the other, and each text's first byte."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _trigger_arrays(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            data, starts = _bytes(part.column("text"))
            keys, first, _ = window_runs(TABLE[data], starts, length, GRAM)
            # A trigger counts once a text: repeats inside one text remove nothing.
            text = np.searchsorted(starts, first, side="right")
            order = np.lexsort((keys, text))
            keys, text = keys[order], text[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
            yield keys[new]


def phrases(part: pa.RecordBatch, sketch: Sketch, length: int) -> pa.RecordBatch:
    """Phrases whose trigger may repeat: key, doc, tid, start, n, cut, phrase.

    Equal phrases of the slice share one row with bytes, of the smallest document.  The trigger's own
    bytes follow from the key, so they are left out where it stands once in its phrase: ``cut`` is
    their place.  Elsewhere ``cut`` is -1 less the place of one of them.
    """
    data, starts = _bytes(part.column("text"))
    symbols = TABLE[data]
    keys, first, count = window_runs(symbols, starts, length, GRAM)
    keep = sketch.repeated(keys)
    keys, first, count = keys[keep], first[keep], count[keep]
    hot = sketch.frequent(keys)
    hasher = Hasher(symbols)
    if hot.any():
        single = gather(np.arange(len(data)), first[hot], count[hot])
        keys = np.concatenate([keys[~hot], hasher.ranges(single, single + length)])
        first = np.concatenate([first[~hot], single])
        count = np.concatenate([count[~hot], np.ones(len(single), np.int64)])
    cut = trigger_places(hasher, keys, first, count, length)
    content = hasher.ranges(first, first + count + length - 1)
    text = np.searchsorted(starts, first, side="right") - 1
    docs = pc.fill_null(part.column("doc"), LAST).to_numpy()[text]
    order = np.lexsort((docs, content, keys))
    keys, first, count, content = keys[order], first[order], count[order], content[order]
    text, docs, cut = text[order], docs[order], cut[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (content[1:] != content[:-1])
    lowest = docs[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else docs
    # A merged row of a larger document is settled; one of the same document needs the bytes' verdict
    # and is kept with them.
    bodied = new | (docs == lowest)
    size = np.where(bodied, count + length - 1, 0)
    shorter = bodied & (cut >= 0)
    head = np.where(shorter, cut, size)
    skip = np.where(shorter, cut + GRAM, size)
    parts = np.stack([first, first + skip], 1).ravel(), np.stack([head, size - skip], 1).ravel()
    offsets = np.concatenate(([0], np.cumsum(head + size - skip))).astype(np.int32)
    blobs = pa.BinaryArray.from_buffers(
        pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(gather(data, *parts).tobytes())]
    )
    # Settled rows need no group: they spread over all tasks.
    tids = part.column("tid").to_numpy().astype(np.int64).view(np.uint64)[text]
    keys = np.where(size > 0, keys, mix(first.astype(np.uint64) ^ content ^ tids))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys.view(np.int64)), pa.array(docs), part.column("tid").take(pa.array(text)),
            pa.array((first - starts[text]).astype(np.int32)), pa.array(count.astype(np.int32)),
            pa.array(cut.astype(np.int32)), blobs,
        ],
        schema=PARSE,
    )


def packed(parts: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of phrases: bucket, block.  A bucket holds whole groups of its keys."""

    def flush(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting).combine_chunks()
        keys = table.column("key").to_numpy()
        bucket = (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((keys, bucket))
        rows, bucket = table.take(pa.array(order)).combine_chunks().to_batches()[0], bucket[order]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cut[1:], len(bucket))
        blocks = [zlib.compress(rows.slice(a, b - a).serialize(), 1) for a, b in zip(cut.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[cut], pa.int64()), pa.array(blocks, pa.binary())], ["bucket", "block"]
        )

    waiting, size = [], 0
    for part in parts:
        if part.num_rows:
            waiting.append(part)
            size += part.num_rows
        if size >= FLUSH_ROWS:
            yield flush(waiting)
            waiting, size = [], 0
    if size:
        yield flush(waiting)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``GROUP_ROWS`` phrases that hold whole groups, from blocks sorted by bucket."""

    def groups(blocks: list[bytes]) -> Iterator[pa.Table]:
        read = [pa.ipc.read_record_batch(pa.py_buffer(zlib.decompress(b)), PARSE) for b in blocks]
        table = pa.Table.from_batches(read).combine_chunks()
        keys = table.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        # Groups may end only where the key changes.
        ends = np.append(np.flatnonzero(np.diff(keys[order])) + 1, len(order))
        begin = 0
        while begin < len(order):
            end = int(ends[min(np.searchsorted(ends, begin + GROUP_ROWS), len(ends) - 1)])
            yield table.take(pa.array(order[begin:end]))
            begin = end

    current, blocks = None, []
    for batch in batches:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block")):
            if bucket != current and blocks:
                yield from groups(blocks)
                blocks = []
            current = bucket
            blocks.append(block.as_py())
    if blocks:
        yield from groups(blocks)


def trigger_places(hasher: Hasher, keys: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Place of the trigger in each phrase if it stands there once, else -1 less its last known place."""
    grams = mix(hasher.every(GRAM))
    found = np.zeros(len(keys), np.int64)
    place = np.zeros(len(keys), np.int64)
    last = count + length - 1 - GRAM
    for d in range(2 * (length - GRAM) + 1):
        at = np.flatnonzero(last >= d)
        at = at[grams[first[at] + d] == keys[at]]
        found[at] += 1
        place[at] = d
    # Runs longer than windows around one trigger repeat it.
    return np.where((found == 1) & (count <= length - GRAM + 1), place, -1 - place)


def whole_phrases(data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, cut: np.ndarray):
    """Phrases with their triggers' bytes again, and their bounds.

    Where no phrase of a trigger has them, a byte that no text has stands for each: all windows hold
    the whole trigger, at the place where it stands once, so equality is the same.
    """
    size = np.diff(bounds)
    shorter = (cut >= 0) & (size > 0)
    wide = np.concatenate(([0], np.cumsum(size + GRAM * shorter)))
    whole = np.full(wide[-1], 255, np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - bounds[row]
    whole[wide[row] + place + GRAM * (shorter[row] & (place >= cut[row]))] = data
    full = np.flatnonzero((cut < 0) & (size > 0))
    if len(full) and shorter.any():
        known, at = np.unique(keys[full], return_index=True)
        mine = np.flatnonzero(shorter)
        place = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
        same = known[place] == keys[mine]
        mine, like = mine[same], full[at[place[same]]]
        step = np.arange(GRAM)
        whole[(wide[mine] + cut[mine])[:, None] + step] = whole[(wide[like] - 1 - cut[like])[:, None] + step]
    return whole, wide


def later_spans(table: pa.Table, length: int) -> pa.RecordBatch:
    """Byte ranges of whole trigger groups that also start in a smaller document."""
    table = table.combine_chunks()
    keys = table.column("key").to_numpy()
    docs = table.column("doc").to_numpy()
    count = table.column("n").to_numpy().astype(np.int64)
    start = table.column("start").to_numpy().astype(np.int64)
    data, bounds = _bytes(table.column("phrase").combine_chunks())
    data, bounds = whole_phrases(data, bounds, keys, table.column("cut").to_numpy().astype(np.int64))
    size = np.diff(bounds)
    settled = size == 0
    symbols = TABLE[data]
    content = Hasher(symbols).ranges(bounds[:-1], bounds[1:])
    # The dictionary: distinct phrases of each trigger with their smallest document.
    live = np.flatnonzero(~settled)
    order = live[np.lexsort((docs[live], content[live], keys[live]))]
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (content[order][1:] != content[order][:-1])
    entry = np.cumsum(new) - 1
    head = order[new]  # the row that stands for each entry
    lowest = docs[head]
    # Triggers with two or more phrases need their suffixes compared.
    entries = keys[head]
    several = np.zeros(len(head), bool)
    if len(head) > 1:
        same = entries[1:] == entries[:-1]
        several[1:] |= same
        several[:-1] |= same
    which = np.flatnonzero(several)
    owner = np.repeat(which, count[head[which]])
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    at = bounds[head[owner]] + place
    best = _smallest(data, at, entries[owner], lowest[owner], length)
    # Windows of each dictionary entry that a smaller document than its own has.
    earlier = best < lowest[owner]
    begins = np.searchsorted(owner, np.arange(len(head) + 1))
    later = docs[order] > lowest[entry]
    # Rows of larger documents go as they stand; the others by their entry's windows.
    whole = np.concatenate([order[later], np.flatnonzero(settled)])
    mine = order[~later & several[entry]]
    of = entry[~later & several[entry]]
    row = np.repeat(mine, count[mine])
    step = np.arange(len(row)) - np.repeat(np.cumsum(count[mine]) - count[mine], count[mine])
    flags = earlier[np.repeat(begins[of], count[mine]) + step] if len(row) else np.zeros(0, bool)
    number = np.repeat(np.arange(len(mine)), count[mine])
    part, begin, width = spans_of(flags, number, start[row] + step, length)
    rows = np.concatenate([whole, mine[part]]) if len(part) else whole
    begin = np.concatenate([start[whole], begin])
    width = np.concatenate([count[whole] + length - 1, width])
    take = pa.array(rows)
    doc = docs[rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc, mask=doc == LAST), table.column("tid").combine_chunks().take(take),
            pa.array(begin.astype(np.int32)), pa.array(width.astype(np.int32)),
        ],
        ["doc", "tid", "start", "length"],
    )


def _smallest(data, at, keys, docs, length: int) -> np.ndarray:
    """For each suffix: the smallest document among suffixes with equal first ``length`` bytes.

    The suffixes are sorted by their bytes, eight at a time, within their trigger.
    """
    if not len(at):
        return docs
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)
    columns = []
    for k in range(0, length, 8):
        k = min(k, length - 8)
        columns.append(np.ascontiguousarray(wide[at + k]).view(">u8").ravel().astype(np.uint64))
    # Most suffixes differ in a mix of all columns: sort by it first, then settle ties by the bytes.
    order = np.lexsort((docs, *reversed(columns), keys))
    new = np.ones(len(at), bool)
    differs = keys[order][1:] != keys[order][:-1]
    for column in columns:
        differs |= column[order][1:] != column[order][:-1]
    new[1:] = differs
    lead = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    best = np.empty(len(at), docs.dtype)
    best[order] = docs[order][lead]
    return best


def earlier_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = BYTES) -> DataFrame:
    """Byte ranges covered by ``length``-byte strings that start in a smaller document."""
    rows = _rows(docs, key, text)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch = merged_sketch(rows.select("text"), lambda b: _trigger_arrays(b, length), size / 14)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    buckets = 1 + size // BUCKET_BYTES

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for batch in batches for part in slices(batch, "text", SLICE))
        return packed((phrases(part, shared.value, length) for part in parts), buckets)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            yield later_spans(table, length)

    rows = rows.withColumn("doc", F.col("doc").cast("long"))
    parse = rows.mapInArrow(emit, "bucket long, block binary")
    return parse.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        group, "doc long, tid int, start int, length int"
    )


def remove_earlier(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = BYTES
) -> DataFrame:
    """Per document: ``key, n_bytes, n_removed, n_spans, kept_sha256, kept`` (binary)."""
    rows = _rows(docs, key, text).withColumn("doc", F.col("doc").cast("long"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts meet their spans by a shuffle, in which they travel compressed.
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                packed = [zlib.compress(t.encode(), 1) for t in part.column("text").to_pylist()]
                columns = [part.column("doc"), part.column("tid"), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "tid", "text"])

    packed = rows.mapInArrow(pack, "doc long, tid int, text binary")
    joined = with_spans(packed, earlier_matches(docs, key, text, length))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in range(batch.num_rows):
                doc, body, spans = (batch.column(c)[row].as_py() for c in ("doc", "text", "spans"))
                data = np.frombuffer(zlib.decompress(body), np.uint8)
                gone = covered(spans, len(data))
                kept = data[~gone].tobytes() if spans else data.tobytes()
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
                size += len(kept)
                if size >= SLICE:
                    yield _digests(out)
                    out, size = [], 0
            yield _digests(out)

    return joined.mapInArrow(
        cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    ).withColumnRenamed("doc", key)


def _digests(out: list[tuple]) -> pa.RecordBatch:
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(6)], names)
