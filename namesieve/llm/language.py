"""Language identification by error-correcting output codes.

Every learned language gets a codeword; one binary n-gram classifier predicts each bit.  A bit's
classifier is the log ratio of n-gram frequencies in languages with and without the bit, scaled by
how well it separates training documents.  Decoding takes the codeword of least weighted logistic
loss and flags texts whose second codeword is nearly as good.

Counts are taken over all training rows; only tables of (language, n-gram bucket) and of
(language, bit) reach the driver, whose size depends on the languages alone.

Defined results: a null text or one without a letter gives ``und`` with score 0; ties go to the first
language in sorted order; rows of a null language are never learned from; without any learned
language every row is ``und``; repeated rows get equal results; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.llm.chunks import slices

BITS = 12
BUCKETS = 1 << BITS
MAX_LANGUAGES = 256
HAS_LETTER = r"\p{L}"


def codewords(n: int) -> np.ndarray:
    """Rows of +1/-1: the exhaustive code for up to 7 languages, else the best of seeded codes."""
    if n <= 7:
        columns = [(1, *rest) for rest in product((1, -1), repeat=max(0, n - 1))][1:]
        return np.array(columns, np.int64).T.reshape(n, -1) if columns else np.ones((n, 1), np.int64)
    width = int(np.ceil(10 * np.log2(n)))
    best, found = -1, None
    for seed in range(64):
        code = np.where(np.random.default_rng(seed).random((n, width)) < 0.5, -1, 1)
        apart = (width - code @ code.T) // 2 + np.eye(n, dtype=np.int64) * width
        if apart.min() > best and (np.abs(code.sum(0)) < n).all():
            best, found = apart.min(), code
    return found


def profiles(texts: pa.Array) -> np.ndarray:
    """Frequencies of hashed byte 1- to 4-grams of lower-cased words, one row per text."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    # A blank on either side of each text keeps grams from crossing texts.
    data = pc.binary_join(
        pa.ListArray.from_arrays([0, len(texts)], texts), " \n "
    )[0].as_py().encode() if len(texts) else b""
    raw = np.frombuffer(b"\n " + data + b" \n", np.uint8)
    symbol = np.where((raw >= 97) & (raw <= 122) | (raw >= 128), raw, 32).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes + 3)[: len(raw)]
    owner = np.concatenate([owner, np.full(len(raw) - len(owner), max(0, len(texts) - 1))])
    grams = symbol.copy()
    result = np.zeros((len(texts), BUCKETS), np.float32)
    flat = result.reshape(-1)
    for n in range(1, 5):
        if n > 1:
            grams = grams[:-1] * np.uint32(0x01000193) ^ symbol[n - 1 :]
        mixed = (grams + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
        # Runs of blanks say nothing.
        real = np.flatnonzero((symbol[: len(grams)] != 32) | (symbol[n - 1 :] != 32))
        at = owner[real].astype(np.int64) * BUCKETS + mixed[real]
        flat += np.bincount(at, minlength=len(flat)).astype(np.float32)
    return result / np.maximum(result.sum(1, keepdims=True), 1)


def _profiled(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most 256 rows and about 2 MB with their profiles."""
    for part in slices(batch, "text", 2 << 20):
        for at in range(0, part.num_rows, 256):
            rows = part.slice(at, 256)
            yield rows, profiles(rows.column("text"))


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    center: np.ndarray
    scale: np.ndarray
    importance: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of the decoded evidence, and the lead over the second."""
        f = np.clip((margins - self.center) * self.scale, -20, 20)
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None]) * self.importance
        total = loss.sum(2)
        best = total.argmin(1)
        share = np.exp(total.min(1, keepdims=True) - total)
        ordered = np.sort(total, 1)
        lead = ordered[:, 1] - ordered[:, 0] if total.shape[1] > 1 else np.full(len(total), np.inf)
        return best, 1 / share.sum(1), lead


def fit_languages(train: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on all rows of ``train`` with a language; two narrow passes, sums only."""
    rows = train.where(F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, freq in _profiled(batch):
                langs = np.array(part.column("lang").to_pylist())
                for one in set(langs):
                    found[one] = found.get(one, 0) + freq[langs == one].sum(0, dtype=np.float64)
        for one, total in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(one, BUCKETS), pa.array(np.arange(BUCKETS), pa.int32()), pa.array(total)],
                ["lang", "bucket", "n"],
            )

    sums = (
        rows.mapInArrow(count, "lang string, bucket int, n double")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(sums["lang"].unique())
    if not languages:
        none = np.zeros(0)
        return LanguageModel([], np.ones((0, 0)), np.zeros((BUCKETS, 0)), none, none, none)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.zeros((len(languages), BUCKETS))
    place = {one: i for i, one in enumerate(languages)}
    table[sums["lang"].map(place), sums["bucket"]] = sums["n"]
    share = table / np.maximum(table.sum(1, keepdims=True), 1e-12)
    code = codewords(len(languages))
    floor = 1e-6
    with_bit = np.stack([share[code[:, b] > 0].mean(0) for b in range(code.shape[1])], 1)
    without = np.stack(
        [
            share[code[:, b] < 0].mean(0) if (code[:, b] < 0).any() else share.mean(0)
            for b in range(code.shape[1])
        ],
        1,
    )
    weights = np.log(with_bit + floor) - np.log(without + floor)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for part, freq in _profiled(batch):
                margins = freq @ weights.astype(np.float32)
                langs = np.array(part.column("lang").to_pylist())
                for one in set(langs):
                    m = margins[langs == one].astype(np.float64)
                    old = found.get(one, [0, 0, 0])
                    found[one] = [old[0] + len(m), old[1] + m.sum(0), old[2] + (m * m).sum(0)]
        bits = weights.shape[1]
        for one, (n, s1, s2) in found.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(one, bits), pa.array(np.arange(bits), pa.int32()),
                    pa.array(np.full(bits, float(n))), pa.array(s1), pa.array(s2),
                ],
                ["lang", "bit", "n", "s1", "s2"],
            )

    stats = (
        rows.mapInArrow(spread, "lang string, bit int, n double, s1 double, s2 double")
        .groupBy("lang", "bit")
        .agg(*(F.sum(c).alias(c) for c in ("n", "s1", "s2")))
        .toPandas()
    )
    shape = (len(languages), code.shape[1])
    n, s1, s2 = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    at = (stats["lang"].map(place), stats["bit"])
    n[at], s1[at], s2[at] = stats["n"], stats["s1"], stats["s2"]
    mean = s1 / np.maximum(n, 1)
    within = np.maximum(s2 / np.maximum(n, 1) - mean**2, 1e-9).mean(0)
    high = np.where(code > 0, mean, np.inf).min(0)
    low = np.where(code < 0, mean, -np.inf).max(0)
    low = np.where(np.isfinite(low), low, high - 1)
    gap = np.maximum(high - low, 1e-6)
    apart = gap / np.sqrt(within)
    # The weight of a bit is how far apart its two sides are, in standard deviations.
    return LanguageModel(
        languages, code, weights, (high + low) / 2, np.minimum(gap / within, 12 / gap), apart / apart.mean()
    )


def identify(
    docs: DataFrame,
    model: LanguageModel,
    key: str = "doc_id",
    text: str = "text",
    ambiguous_below: float = 1.0,
) -> DataFrame:
    """``key, lang_pred, score, ambiguous`` of every row; narrow, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], dtype=object)
        weights = model.weights.astype(np.float32)
        for batch in batches:
            for part, freq in _profiled(batch):
                texts = pc.fill_null(part.column("text"), "")
                known = pc.match_substring_regex(texts, HAS_LETTER).to_numpy(zero_copy_only=False)
                if model.languages:
                    best, score, lead = model.decide(freq @ weights)
                else:
                    best = np.zeros(len(texts), int)
                    score = lead = np.zeros(len(texts))
                    known = known & False
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(names[np.where(known, best, len(model.languages))], pa.string()),
                        pa.array(np.where(known, score, 0.0), pa.float64()),
                        pa.array(~known | (lead < ambiguous_below)),
                    ],
                    ["key", "lang_pred", "score", "ambiguous"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, lang_pred string, score double, ambiguous boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
