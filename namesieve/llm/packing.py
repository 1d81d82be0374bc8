"""Best-fit packing with bounds that certify it.

Documents are tokenised once and cut only if they are longer than a sequence.  Pieces are dealt to
partitions and packed there by best-fit decreasing.  Dual feasible functions give a lower bound on
each partition's sequences; a partition that meets its bound is certified.  The others pool the
documents of their unfilled sequences in groups of ``merge`` partitions and run best-fit decreasing
again; the result is taken only where it needs fewer sequences.  The number of partitions grows with
the pieces, so a task holds about ``per_part`` pieces (times ``merge`` per exchange round).

Defined results: a null or empty text is the separator alone (one token); repeated rows are packed
each on its own; ties in length are broken by id and piece; an empty table gives no rows; extra
columns are left out; very long texts become full pieces and one shorter first piece.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.llm.bpe import PIECES, byte_symbols
from namesieve.llm.chunks import chunked, gather, lean, slices, split_tails, uncut
from namesieve.session import checkpointed

CAPACITY = 2048


class Encoder:
    """Token ids of texts as the tokenizers library gives them for a byte-level file.

    Files whose ids are their merge ranks are encoded chunk by chunk with the rank encoder of
    tiktoken, which is several times faster; any other file goes through tokenizers itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        shown = byte_symbols()
        byte = {c: i for i, c in enumerate(shown)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, self.special)))
        tokens = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        merges = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        ordered = [tokens.get(m) for m in merges]
        if ordered == sorted(x for x in ordered if x is not None) and len(tokens) == 256 + len(merges):
            import tiktoken

            ranks = {bytes(byte[c] for c in t): i for t, i in tokens.items()}
            plain = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            self.plain = plain.encode_ordinary
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            self.plain = lambda text: library.encode(text, add_special_tokens=False).ids
        spaced = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        spaced[[i for t, i in tokens.items() if t[0] == shown[32]]] = True
        self.spaced = spaced

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special strings, however many, are cut out one after the other."""
        ids, at = [], 0
        for found in self.specials.finditer(text) if self.special else ():
            ids += self.plain(text[at : found.start()]) if found.start() > at else []
            ids.append(self.special[found[0]])
            at = found.end()
        return ids + (self.plain(text[at:]) if at < len(text) else []) if at else self.plain(text)

    def _inner(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each chunk.

        Chunks of letters are encoded in one call: a token that begins with a space begins a chunk.
        """
        letters = np.fromiter(map(str.isalpha, chunks), bool, len(chunks))
        joined = " ".join(chain(("",), (c for c in chunks if c.isalpha())))
        first = np.fromiter(self.plain(joined) if letters.any() else (), np.uint32)
        begins = np.flatnonzero(self.spaced[first])
        others, n_others = self._flat([self.encode(" " + c) for c in chunks if not c.isalpha()])
        sizes = np.empty(len(chunks), np.int64)
        sizes[letters] = np.diff(begins, append=len(first))
        sizes[~letters] = n_others
        at = np.empty(len(chunks), np.int64)
        at[letters] = begins
        at[~letters] = len(first) + np.cumsum(n_others) - n_others
        return gather(np.concatenate([first, others]), at, sizes), sizes

    @staticmethod
    def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's ids."""
        whole = pa.array(uncut(texts))
        distinct, codes, starts = chunked(pc.if_else(whole, "", texts))
        stems, stem_of, tails, tail_of = split_tails(distinct)
        known, n_known = self._inner(stems)
        # Tails, first chunks (no space before them; an uncut text is one first chunk) and nothing.
        firsts = pc.list_slice(pc.split_pattern(texts, " ", max_splits=1), 0, 1).flatten()
        heads = pc.if_else(whole, texts, firsts).dictionary_encode()
        other = [*tails, *heads.dictionary.to_pylist(), ""]
        values, sizes = self._flat([self.encode(x) for x in other])
        base = len(stems)
        values, sizes = np.concatenate([known, values]), np.concatenate([n_known, sizes])
        begins = np.cumsum(sizes) - sizes
        pair = np.empty((len(codes), 2), np.int64)
        pair[:, 0] = stem_of[codes]
        pair[:, 1] = base + tail_of[codes]
        pair[starts[:-1], 0] = base + len(tails) + heads.indices.to_numpy()
        pair[starts[:-1], 1] = base + len(other) - 1
        pair = pair.ravel()
        each = sizes[pair]
        total = np.concatenate(([0], np.cumsum(each)))[2 * starts]
        return gather(values, begins[pair], each), np.diff(total)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, separator: int = 0,
) -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids_crc32.  Narrow, without an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, sizes = encode.ids(pc.fill_null(part.column("text"), ""))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, separator).astype("<u4")
                total = sizes + 1
                begins = np.cumsum(total) - total
                count = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                short = total - (count - 1) * capacity  # the first piece takes what is over
                start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[row], capacity)
                at = begins[row] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(pa.array(row)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["key", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"key {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs, by dual feasible functions over the length histogram.

    For each k: pieces longer than capacity - k count whole, pieces shorter than k count nothing,
    others count by length; and the rounding functions floor((m + 1) x) / m.  k = 0 is the volume bound.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    sizes = np.arange(capacity + 1)
    number = np.concatenate(([0], np.cumsum(counts)))
    volume = np.concatenate(([0], np.cumsum(counts * sizes)))
    k = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - k + 1]
    middle = volume[capacity - k + 1] - volume[k]
    best = int(np.max(large + -(-middle // capacity)))
    for m in range(2, 21):
        scaled = (m + 1) * sizes
        exact = scaled % capacity == 0
        parts = np.where(exact, scaled * m, scaled // capacity * (m + 1) * capacity)
        best = max(best, -(-int((counts * parts).sum()) // (m * (m + 1) * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence of each piece by best-fit decreasing; equal lengths in the given order.

    Open sequences are stacked by the room left; a bit mask finds the least sufficient room.
    """
    sequence = np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, at = capacity, opened
            opened += 1
        sequence[i] = at
        left = room - n
        if left:
            if not rooms[left]:
                mask |= 1 << left
            rooms[left].append(at)
    return sequence


def _places(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["bin", "key", "piece"], kind="stable")
    frame["offset"] = frame.groupby("bin")["length"].cumsum() - frame["length"]
    frame["filled"] = frame.groupby("bin")["length"].transform("sum")
    return frame


def _pack(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values(["key", "piece"], kind="stable")
    lengths = frame["length"].to_numpy()
    frame["bin"] = best_fit(lengths, capacity)
    frame["gap"] = int(frame["bin"].max()) + 1 - lower_bound(lengths, capacity)
    return _places(frame)


def _repack(frame: pd.DataFrame, capacity: int, tag: int) -> pd.DataFrame:
    """Pack the pool of several partitions anew; keep the old places unless fewer sequences do."""
    frame = frame.sort_values(["key", "piece"], kind="stable")
    lengths = frame["length"].to_numpy()
    bins = best_fit(lengths, capacity)
    before = len(frame[["part", "bin"]].drop_duplicates())
    if int(bins.max()) + 1 >= before:
        return frame
    frame["bin"] = bins
    frame["part"] = frame["pool"] + tag
    frame["gap"] = int(bins.max()) + 1 - lower_bound(lengths, capacity)
    return _places(frame)


def _repacker(capacity: int, tag: int, columns: list[str]):
    return lambda frame: _repack(frame, capacity, tag)[columns]


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    per_part: int = 50_000,
    merge: int = 8,
    rounds: int = 2,
) -> DataFrame:
    """Add sequence_id, offset, and the certificate: ``gap`` (0: the partition meets its bound).

    A piece of full length is a sequence of its own.
    """
    spread = checkpointed(pieces)
    parts = max(1, -(-spread.count() // per_part))
    names = [f.name for f in pieces.schema]
    keep = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    schema = f"{keep}, part long, bin long, gap long, offset long, filled long"
    columns = [*names, "part", "bin", "gap", "offset", "filled"]
    dealt = spread.withColumn("part", F.pmod(F.xxhash64("key", "piece"), F.lit(parts)))
    packed = dealt.groupBy("part").applyInPandas(
        lambda frame: _pack(frame, capacity)[columns], schema
    )
    for k in range(rounds if parts > 1 else 0):
        packed = checkpointed(packed)
        # Partitions above their bound, grouped by merge; ids of pools never meet ids of partitions.
        open_ = (F.col("gap") > 0) & (F.col("filled") < capacity)
        stay, pool = packed.where(~open_), packed.where(open_)
        groups = max(1, -(-parts // merge ** (k + 1)))
        pool = pool.withColumn("pool", F.pmod(F.xxhash64("part"), F.lit(groups)))
        again = pool.groupBy("pool").applyInPandas(_repacker(capacity, (k + 1) << 40, columns), schema)
        packed = stay.unionByName(again)
    return packed.select(
        *names,
        (F.col("part") * (1 << 20) + F.col("bin")).alias("sequence_id"),
        "offset",
        "gap",
    )


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences in use, the volume bound, and the largest gap of a partition."""
    return packed.agg(
        F.countDistinct("sequence_id").alias("sequences"),
        F.ceil(F.sum("length") / capacity).alias("volume_bound"),
        F.max("gap").alias("largest_gap"),
    )
