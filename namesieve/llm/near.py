"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of word shingles.  Equal sets form a class with one representative.  Representatives
that agree in a band of MinHash values are linked into candidate groups; inside a group pairs compare
their MinHash values step by step, and a pair is dropped when the posterior probability that its
similarity reaches the threshold falls below ``tolerance`` (uniform prior).  What is left is verified
exactly on the shingle sets.

A candidate group is cut into blocks of bounded size; each pair of blocks is one unit of work, so no
group is collected in one task, and no pair is written as a row: a unit returns per representative the
number of documents linked to it and its smallest neighbour.  No cap on partners or candidates.

Defined results: words are split at blanks and lower-cased; a text of fewer words than a shingle is
one shingle of all its words; a text without words has no class but itself and no links; rows with
null ids are kept, their class is the smallest non-null id or null; repeated rows are documents of
their own; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.llm.chunks import lean, slices
from namesieve.llm.substrings import Words
from namesieve.llm.windows import Hasher, whole_groups
from namesieve.session import checkpointed

WIDTH, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 25, 4
STEP = 20
TOLERANCE = 1e-6
BLOCK_SHINGLES = 60_000
EMPTY = np.uint32(0xFFFFFFFF)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, with the bounds."""
    words = Words(pc.utf8_lower(texts))
    counts = np.diff(words.starts)
    hasher = Hasher(words.hashes)
    n = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    owner = np.repeat(np.arange(len(n)), n)
    begin = words.starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    values = hasher.ranges(begin, np.minimum(begin + width, words.starts[owner + 1]))
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[new], values[new]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def minhashes(values: np.ndarray, bounds: np.ndarray, number: int) -> np.ndarray:
    """MinHash values (uint32) of every set; empty sets get the largest value."""
    draw = np.random.default_rng(6)
    a = draw.integers(1, 2**63, number, dtype=np.uint64) | np.uint64(1)
    b = draw.integers(0, 2**63, number, dtype=np.uint64)
    sizes = np.diff(bounds)
    result = np.full((len(sizes), number), EMPTY, np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        at = bounds[:-1][full]
        for i in range(number):
            mixed = ((values * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32)
            result[full, i] = np.minimum.reduceat(mixed, at)
    return result


def least_matches(step: int, n: int, threshold: float, tolerance: float) -> list[int]:
    """Matches a pair needs after ``step``, ``2 step`` ... values to keep its posterior above tolerance.

    With a uniform prior the posterior after m matches of k is Beta(m + 1, k - m + 1); its upper tail
    at the threshold is a binomial sum.
    """

    def tail(m: int, k: int) -> float:
        return sum(
            comb(k + 1, j) * threshold**j * (1 - threshold) ** (k + 1 - j) for j in range(m + 1)
        )

    return [
        next(m for m in range(k + 1) if tail(m, k) >= tolerance) for k in range(step, n + 1, step)
    ]


def band_keys(sign: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each signature."""
    weights = np.random.default_rng(16).integers(1, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)
    parts = sign.reshape(len(sign), BANDS, BAND_ROWS).astype(np.uint64)
    keys = (parts * weights).sum(2, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)


def set_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return Hasher(values).ranges(bounds[:-1], bounds[1:]).view(np.int64)


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """Per row of (doc, tid, text): doc, tid, n_shingles, set_hash (of the whole set), bands (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                values, bounds = shingle_sets(part.column("text"), width)
                keys = band_keys(minhashes(values, bounds, BANDS * BAND_ROWS))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"), part.column("tid"), pa.array(np.diff(bounds).astype(np.int32)),
                        pa.array(set_hashes(values, bounds)),
                        pa.array([r.tobytes() for r in keys], pa.binary()),
                    ],
                    ["doc", "tid", "n_shingles", "set_hash", "bands"],
                )

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc {kind}, tid long, n_shingles int, set_hash long, bands binary")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges: node, root (the smallest node).

    Every round each node takes the smallest root of its neighbours, and roots are shortened by
    looking up the root's root.  Rounds are checkpointed; their number grows with the logarithm of
    the longest path.
    """
    both = checkpointed(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    roots = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("root")
    )
    roots = checkpointed(roots)
    while True:
        near = (
            both.join(roots, both["b"] == roots["node"])
            .groupBy("a").agg(F.min("root").alias("near"))
        )
        hop = roots.select(F.col("node").alias("r"), F.col("root").alias("far"))
        step = (
            roots.join(near, roots["node"] == near["a"], "left")
            .withColumn("best", F.least("root", "near"))
            .join(hop, F.col("best") == F.col("r"), "left")
            .select("node", F.least("best", "far").alias("new"), "root")
        )
        step = checkpointed(step)
        changed = step.where(F.col("new") != F.col("root")).limit(1).count()
        roots = step.select("node", F.col("new").alias("root"))
        if not changed:
            return roots


def candidate_groups(sets: DataFrame) -> DataFrame:
    """Representatives linked through equal bands: node, root.  One star per bucket, so linear."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
                nodes = batch.column("set_hash").take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), nodes], ["band", "node"])

    rows = sets.select("set_hash", "bands").mapInArrow(lean(split), "band long, node long")
    # Within a bucket every member is linked to the smallest: hot buckets are combined map-side.
    stars = rows.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
    stars = stars.where("low <> high").select("band", "low")
    # A node keeps one edge, to the least of its buckets' smallest members; those meet through it.
    held = rows.join(stars, "band").groupBy("node").agg(F.min("low").alias("least"), F.collect_set("low").alias("lows"))
    own = held.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    met = held.select(F.explode("lows").alias("a"), F.col("least").alias("b")).where("a <> b")
    return components(own.union(met).distinct())


def _links(sign, shingles, weights, other: bool, split: int, threshold: float, tolerance: float):
    """Verified pairs among rows (or, with ``other``, between rows before and after ``split``)."""
    n = len(sign)
    if other:
        i, j = np.divmod(np.arange(split * (n - split)), n - split)
        j = j + split
    else:
        i, j = np.triu_indices(n, 1)
    needed = least_matches(STEP, sign.shape[1], threshold, tolerance)
    matches = np.zeros(len(i), np.int32)
    for k, least in enumerate(needed):
        part = sign[:, k * STEP : (k + 1) * STEP]
        for at in range(0, len(i), 1 << 16):
            piece = slice(at, at + (1 << 16))
            matches[piece] += (part[i[piece]] == part[j[piece]]).sum(1)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    if not len(i):
        return i, j
    # Exact: intersections of the sets, through incidence of the shingles that two sets share.
    sizes = np.array([len(s) for s in shingles])
    used = np.unique(np.concatenate([i, j]))
    place = np.full(n, -1)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), sizes[used])
    values = np.concatenate([shingles[u] for u in used])
    distinct, code = np.unique(values, return_inverse=True)
    shared = np.bincount(code, minlength=len(distinct)) > 1
    column = np.cumsum(shared) - 1
    inside = shared[code]
    owner, code = owner[inside], column[code[inside]]
    both = np.zeros((len(used), len(used)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        own = (code >= at) & (code < at + 4096)
        block = np.zeros((len(used), 4096), np.float32)
        block[owner[own], code[own] - at] = 1
        both += block @ block.T
    inter = both[place[i], place[j]].astype(np.int64)
    union = sizes[i] + sizes[j] - inter
    # Compared in whole numbers, as threshold is a decimal of at most six places.
    keep = inter * 1_000_000 >= round(threshold * 1_000_000) * union
    return i[keep], j[keep]


def jaccard_join(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per document: ``key, class_id, n_links``.

    ``class_id`` is the smallest id among all documents connected by links; ``n_links`` counts the
    other documents of similarity ``threshold`` or more, copies included.
    """
    member, named = _classes(docs, key, text, width, threshold, tolerance)
    ids = named.groupBy("root").agg(F.min("low.doc").alias("class_id"))
    named = named.join(ids, "root").select(
        F.col("set_hash"), "class_id", (F.col("n") + F.col("weight") - 1).alias("links")
    )
    hit = member.join(named.withColumn("has", F.lit(1)), "set_hash", "left")
    alone = F.col("n_shingles") == 0
    return hit.select(
        F.col("doc").alias(key),
        F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
    )


def text_hash(text: str) -> Column:
    """Tells rows of one id, or of none, apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _classes(
    docs: DataFrame, key: str, text: str, width: int, threshold: float, tolerance: float
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, tid, n_shingles, set_hash), and of each set: set_hash, weight, low, root, n.

    ``low`` is the smallest row of the set (none, doc, tid), rows without an id last; ``root`` names
    the class.
    """
    texts = docs.select(
        F.col(key).alias("doc"), text_hash(text).alias("tid"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    sets = checkpointed(signatures(texts, width))
    member = sets.select("doc", "tid", "n_shingles", "set_hash")
    real = sets.where("n_shingles > 0")
    lowest = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "tid")).alias("low")
    classes = real.groupBy("set_hash").agg(
        F.count("*").alias("weight"), lowest, F.first("n_shingles").alias("n_shingles")
    )
    # One row per distinct set in a candidate group; its text is fetched once by the smallest row.
    groups = candidate_groups(real)
    chosen = groups.join(classes, groups["node"] == classes["set_hash"]).drop("node")
    chosen = checkpointed(chosen)
    # Blocks of bounded size: a set's block is drawn from its hash, their number from the group's size.
    sizes = chosen.groupBy("root").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("n"))
    sizes = sizes.select(
        "root",
        F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("n") / 128)).cast("int").alias("blocks"),
    )
    dealt = chosen.join(sizes, "root").withColumn(
        "block", F.pmod(F.xxhash64("set_hash"), F.col("blocks")).cast("int")
    )
    dealt = dealt.withColumn("low_doc", F.col("low.doc")).withColumn("low_tid", F.col("low.tid")).drop("low")
    same = texts["doc"].eqNullSafe(dealt["low_doc"]) & (texts["tid"] == dealt["low_tid"])
    bodies = texts.join(dealt, same).drop("doc", "tid", "low_doc", "low_tid")
    pairs = bodies.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = pairs.select(
        F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        "block", "other", "set_hash", "weight", "text",
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit", 64):
            table = table.combine_chunks()
            unit = table.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(unit)) + 1), len(unit)]
            nodes = table.column("set_hash").to_numpy()
            weight = table.column("weight").to_numpy()
            block = table.column("block").to_numpy()
            other = table.column("other").to_numpy()
            for a, b in zip(cuts, cuts[1:]):
                values, bounds = shingle_sets(table.column("text").combine_chunks().slice(a, b - a), width)
                # Rows equal in id and text count once.
                right = np.flatnonzero(set_hashes(values, bounds) == nodes[a:b])
                right = right[np.unique(nodes[a:b][right], return_index=True)[1]]
                cross = bool((block[a:b] != other[a:b]).any())
                if cross:
                    right = right[np.argsort(block[a:b][right], kind="stable")]
                own = a + right
                split = int((block[own] == block[own].min()).sum()) if cross and len(own) else 0
                if len(own) < 2 or cross and split == len(own):
                    continue  # alone, or the other block is empty
                sign = minhashes(values, bounds, BANDS * BAND_ROWS)[right]
                shingles = [values[bounds[r] : bounds[r + 1]] for r in right]
                i, j = _links(sign, shingles, weight[own], cross, split, threshold, tolerance)
                n = np.zeros(len(own), np.int64)
                np.add.at(n, i, weight[own[j]])
                np.add.at(n, j, weight[own[i]])
                node = nodes[own]
                root = _forest(len(own), i, j, node)
                found = np.flatnonzero(n)
                if len(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[found]), pa.array(root[found]), pa.array(n[found])],
                        ["node", "root", "n"],
                    )

    linked = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(
        lean(link), "node long, root long, n long"
    )
    linked = checkpointed(linked)
    counts = linked.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(linked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = roots.withColumnRenamed("node", "r_node")
    named = classes.join(counts, classes["set_hash"] == counts["node"], "left").join(
        roots, F.col("set_hash") == F.col("r_node"), "left"
    )
    return member, named.select(
        "set_hash", "weight", "low", F.coalesce("root", "set_hash").alias("root"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def _forest(n: int, i: np.ndarray, j: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Smallest node of each row's component."""
    root = node.copy()
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        if (low == root).all():
            return root
        root = low


def keep_one(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row of ``docs`` for each class, that of the smallest id; texts without words all stay.

    Rows of a null or repeated id are told apart by their text; rows without an id come last.
    """
    member, named = _classes(docs, key, text, width, threshold, tolerance)
    first = named.groupBy("root").agg(F.min("low").alias("low")).select("low.doc", "low.tid")
    alone = member.where("n_shingles = 0").select("doc", "tid").distinct()
    copies = member.where("n_shingles > 0").groupBy("doc", "tid").count().where("count > 1")
    copies = copies.select(F.col("doc").alias("c_doc"), F.col("tid").alias("c_tid"))
    if not copies.limit(1).count():
        return _rows_of(docs, first.union(alone), key, text)
    # Rows equal in id and text cannot be told apart by a key: one of them is taken.
    several = F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("tid") == F.col("c_tid"))
    once = _rows_of(docs, first.union(alone).join(copies, several, "left_anti"), key, text)
    some = _rows_of(docs, first.join(copies, several, "left_semi"), key, text).withColumn("_tid", text_hash(text))
    return once.union(some.dropDuplicates([key, "_tid"]).drop("_tid"))


def _rows_of(docs: DataFrame, kept: DataFrame, key: str, text: str) -> DataFrame:
    kept = kept.select(F.col("doc").alias("_kept"), F.col("tid").alias("_tid"))
    return docs.join(kept, F.col(key).eqNullSafe(F.col("_kept")) & (text_hash(text) == F.col("_tid")), "left_semi")
