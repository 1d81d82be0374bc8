"""Arrow helpers of the text operators: bounded slices and space-separated chunks.

In byte-level BPE a single space between two characters that are not blanks always begins a piece,
so a text may be cut there and equal chunks be encoded once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
# A space beside another blank: such texts are not cut.  A superset of the blanks is harmless.
BESIDE_BLANK = (
    r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
BESIDE_BLANK = f"{BESIDE_BLANK} | {BESIDE_BLANK}"


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts have about ``limit`` bytes, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    parts = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; a task that ends gives its freed memory back to the system.

    Workers serve task after task and stage after stage; what their allocators keep would add up.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return task


def chunked(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks, the code of each chunk, and each text's first chunk (with the end)."""
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(), offsets - offsets[0]


def uncut(texts: pa.Array) -> np.ndarray:
    """Which texts have a space beside another blank."""
    return pc.match_substring_regex(texts, BESIDE_BLANK).to_numpy(zero_copy_only=False)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive ``starts``; empty ranges give 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


TAIL = ".,;:!?)*#$%&"
BEFORE_TAIL = r"(?s)^.*[^.,;:!?)*#$%&]"


def strings(chunks: pa.Array) -> list[str]:
    """Python strings of chunks, which hold no space; much faster than one conversion for each."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), " ")[0].as_py().split(" ")


def split_tails(distinct: pa.Array) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Letters and closing punctuation of the chunks, each with its distinct values and codes.

    Letters after a space are one piece and punctuation after them is another.  A chunk of another
    form is left whole, with an empty tail.
    """
    cut = pc.utf8_rtrim(distinct, characters=TAIL)
    plain = pc.utf8_is_alpha(cut)
    stems = pc.if_else(plain, cut, distinct)
    tailed = pc.and_(plain, pc.not_equal(pc.binary_length(stems), pc.binary_length(distinct)))
    tails = pc.replace_substring_regex(distinct.filter(tailed), BEFORE_TAIL, "")
    tails = pc.replace_with_mask(pa.repeat("", len(distinct)), tailed, tails)
    a, b = stems.dictionary_encode(), tails.dictionary_encode()
    return strings(a.dictionary), a.indices.to_numpy(), b.dictionary.to_pylist(), b.indices.to_numpy()


def gather(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges ``values[b : b + n]``, one after the other."""
    ends = np.cumsum(sizes)
    shift = np.repeat(begins - (ends - sizes), sizes)
    return values[shift + np.arange(int(ends[-1]) if len(ends) else 0)]
