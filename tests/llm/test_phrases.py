"""Phrases without their triggers against brute force, on small alphabets and periodic texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from namesieve.llm import parsing


class Everything:
    """A sketch that calls every key repeated, and a third of them frequent if asked."""

    def __init__(self, hot: bool):
        self.hot = hot

    def repeated(self, keys):
        return np.ones(len(keys), bool)

    def frequent(self, keys):
        return keys % np.uint64(3) == 0 if self.hot else np.zeros(len(keys), bool)


def expected(texts: list[str]) -> list[np.ndarray]:
    first: dict[bytes, int] = {}
    data = [t.encode() for t in texts]
    for d, b in enumerate(data):
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    result = []
    for d, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        result.append(gone)
    return result


@pytest.mark.parametrize("hot", (False, True))
def test_phrases_without_triggers(hot):
    for seed in range(60):
        draw = random.Random(seed)
        letters = draw.choice(["ab", "a", "abc\0", "abcdefghij klm", "\u00e9\0x"])
        pool = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 160))) for _ in range(4)]
        pool.append((draw.choice(pool)[: draw.randint(1, 30)] or "a") * draw.randint(2, 12))
        texts = ["".join(draw.choice([*pool, letters]) for _ in range(draw.randint(0, 5))) for _ in range(9)]
        parts = []
        for ids in (range(4), range(4, 9)):
            own = pa.array([texts[i] for i in ids], pa.string())
            rows = [pa.array(ids, pa.int64()), pa.array(ids, pa.int32()), own]
            part = pa.RecordBatch.from_arrays(rows, ["doc", "tid", "text"])
            parts.append(parsing.phrases(part, Everything(hot), 50))
        spans = parsing.later_spans(pa.Table.from_batches(parts).sort_by("key"), 50)
        found = [np.zeros(len(t.encode()), bool) for t in texts]
        for s in spans.to_pylist():
            found[s["doc"]][s["start"] : s["start"] + s["length"]] = True
        assert all((a == b).all() for a, b in zip(found, expected(texts))), seed


def test_blocks_hold_whole_groups(monkeypatch):
    """Every phrase comes back once, in tables that part no group."""
    monkeypatch.setattr(parsing, "FLUSH_ROWS", 700)
    monkeypatch.setattr(parsing, "GROUP_ROWS", 300)
    draw = np.random.default_rng(3)
    parts = []
    for size in (0, 500, 1, 900, 2500):
        keys = draw.integers(-60, 60, size) * 10**15
        columns = [keys, draw.integers(0, 99, size)] + [draw.integers(0, 9, size).astype(np.int32) for _ in range(4)]
        columns.append(pa.array([bytes(str(k), "ascii") * 3 for k in keys], pa.binary()))
        parts.append(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=parsing.PARSE))
    blocks = pa.Table.from_batches(list(parsing.packed(iter(parts), 7))).sort_by("bucket")
    assert len(set(blocks.column("bucket").to_pylist())) == 7
    tables = list(parsing.whole_buckets(blocks.to_batches(max_chunksize=3)))
    rows = [tuple(r.values()) for t in tables for r in t.to_pylist()]
    assert sorted(rows) == sorted(tuple(r.values()) for p in parts for r in p.to_pylist())
    keys = [set(t.column("key").to_pylist()) for t in tables]
    assert len(tables) > 7 and sum(map(len, keys)) == len(set().union(*keys))
    assert not list(parsing.packed(iter(parts[:1]), 7)) and not list(parsing.whole_buckets(iter([])))
