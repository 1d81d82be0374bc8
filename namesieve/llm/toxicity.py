"""Toxicity of restored text: noisy-channel deobfuscation, then a word model.

A character trigram model is counted over all texts.  Tokens that may be disguised (digits and
symbols inside, repeated letters, letters with separators, runs of single letters) become lattices:
each character is kept, replaced, dropped or read as a boundary at a cost, and a Viterbi search finds
the cheapest path under the language model.  Other tokens have one path.  The restored words are
scored by a noisy-or of the words that training documents show to be toxic.

Defined results: null, empty and wordless texts get the base rate; a long text is searched token by
token, whole; doubled letters are read as they stand and as single ones, the spelling with most letters
that is listed counts; pieces between blanks are joined if they make up a listed word and are not all
ordinary words of the training texts; repeated rows get equal results; without labelled rows the score is 0; extra columns are
left out.  Near copies among training documents count once (one per bottom sketch of the words).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Set
from dataclasses import dataclass, field
from itertools import groupby, product
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.llm.chunks import chunked, lean, slices, split_tails
from namesieve.session import checkpointed

# Runs of blanks, ASCII or not.
BLANKS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
DOUBLED = re.compile(r"(.)\1")
REPEATED = re.compile(r"(?s)(.)\1+")
# Letters that digits and symbols stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = " .,-_*'`~^:;/\\"
EDGE = ".,;:!?)(*#$%&\"'[]{}<>|»«…-_"  # punctuation around a word; some of it is in LEET
REPLACE, DROP, JOIN, BREAK = 0.7, 4.0, 0.2, 0.5
LOSE = 3.0  # more, if the character has letters to stand for
N = 27  # boundary and a-z
MAX_CACHE = 60_000
SIGN = 6  # least word hashes that make near copies among training documents alike


def char_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of a-z and boundaries over all texts: a fixed table of 27 x 27 x 27."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        letter = np.zeros(256, np.int64)
        letter[97:123] = np.arange(1, 27)
        letter[65:91] = np.arange(1, 27)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = part.column("text").drop_null()
                joined = pa.ListArray.from_arrays([0, len(texts)], texts)
                data = ("  " + (pc.binary_join(joined, "  ")[0].as_py() or "") + " ").encode()
                c = letter[np.frombuffer(data, np.uint8)]
                grams = c[:-2] * N * N + c[1:-1] * N + c[2:]
                total += np.bincount(grams, minlength=N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = docs.select(F.col(text).alias("text"))
    table = rows.mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(N**3, np.int64)
    for gram, n in table.collect():  # at most 27 ** 3 rows
        counts[gram] = n
    return counts


def char_costs(counts: np.ndarray) -> list[list[float]]:
    """-log P(third | first two), interpolated with shorter contexts; by (first * 27 + second)."""
    tri = counts.reshape(N * N, N).astype(float)
    bi = counts.reshape(N, N, N).sum(0).astype(float)
    uni = bi.sum(0)
    p1 = (uni + 1) / (uni.sum() + N)
    kinds = lambda t: (t > 0).sum(1, keepdims=True)
    p2 = (bi + (kinds(bi) + 1) * p1) / (bi.sum(1, keepdims=True) + kinds(bi) + 1)
    p3 = (tri + (kinds(tri) + 1) * np.tile(p2, (N, 1))) / (tri.sum(1, keepdims=True) + kinds(tri) + 1)
    return (-np.log(p3)).tolist()


class Restorer:
    """Restores tokens and runs of single letters; keeps a bounded cache."""

    def __init__(self, costs: list[list[float]]):
        self.costs = costs
        self.cache: dict[str, list[str]] = {}

    def options(self, text: str, i: int) -> list[tuple[str, float]]:
        """What the character at ``i`` may stand for, with costs; a space is a boundary."""
        c = text[i]
        if "a" <= c <= "z":
            return [(c, 0.0)]  # repeated letters are left to spellings() and Listed
        found = [(x, REPLACE) for x in LEET.get(c, "")]
        if c in SEPARATORS:
            found += [("", JOIN), (" ", BREAK)]
        elif c.isalpha():
            found.append((c, 0.0))
        else:
            lose = LOSE if found else 0.0
            found += [("", DROP + lose), (" ", BREAK + lose)]
        return found

    def decode(self, text: str, begin: int = 0, end: int | None = None) -> str:
        """Viterbi search over states of the last two characters.

        Before ``begin`` and from ``end`` on, what can be a letter is one.
        """
        end = len(text) if end is None else end
        costs = self.costs
        states: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, " "): (0.0, "")}
        for i in range(len(text)):
            after: dict[tuple[int, int, str], tuple[float, str]] = {}
            options = self.options(text, i)
            if not begin <= i < end and text[i] in LEET:
                options = [(x, price) for x, price in options if x.isalpha()]
            for out, price in options:
                for (a, b, last), (cost, done) in states.items():
                    if not out:
                        state, total, word = (a, b, last), cost + price, done
                    elif out == " " and last == " ":
                        state, total, word = (a, b, last), cost + price, done
                    else:
                        # Letters outside a-z are boundaries to the model and kept in the text.
                        z = ord(out) - 96 if "a" <= out <= "z" else 0
                        total = cost + price + costs[a * N + b][z]
                        state, word = (b, z, out), done + out
                    if total < after.get(state, (inf, ""))[0]:
                        after[state] = (total, word)
            states = after
        ends = [(cost + costs[a * N + b][0], word) for (a, b, _), (cost, word) in states.items()]
        return min(ends)[1]

    def token(self, token: str) -> list[str]:
        """Lower-cased words of a token, restored if it may be disguised."""
        found = self.cache.get(token)
        if found is None:
            low = token.lower()
            if low.isalpha() and not DOUBLED.search(low):
                return [low]  # one reading; most tokens, so the cache is left to the others
            core = low.strip(EDGE)
            wider = _wider(low)
            if "\n" in low or "\t" in low or "\r" in low:
                found = [w for x in low.split() for w in self.token(x)]
            elif core.isnumeric() and sum(c in LEET for c in low) <= sum(c in LEET for c in core) + 1:
                found = [core]  # a number or a price
            else:
                # Symbols at the ends may be letters, as in a$$ or $tupid!: each may belong to the word.
                found = [core] if core.isnumeric() or core.isalpha() else self.decode(core).split()
                found += [w for x in wider for w in self.decode(*x).split()]
                found = list(dict.fromkeys(x for w in found for x in spellings(w)))
            if len(self.cache) >= MAX_CACHE:
                self.cache.clear()
            self.cache[token] = found
        return found


_restorers: dict[int, Restorer] = {}


def restorer(costs: list[list[float]]) -> Restorer:
    """The restorer of these costs in this worker process: its cache serves all tasks and passes."""
    key = hash(tuple(map(tuple, costs)))
    if key not in _restorers:
        _restorers.clear()
        _restorers[key] = Restorer(costs)
    return _restorers[key]


def _wider(low: str) -> list[tuple[str, int, int]]:
    """A token's core with LEET characters around it: text, begin and end of the core in it.

    A stretch of equal characters is taken whole or not at all.  Words of more than 40 letters are
    not learned, so no more than 40 stretches a side are looked at.
    """
    if not (low[:1] in EDGE or low[-1:] in EDGE):
        return []
    head = len(low) - len(low.lstrip(EDGE))
    tail = max(head, len(low.rstrip(EDGE)))
    begins = [i for i in range(head) if low[i] in LEET and (not i or low[i - 1] != low[i])][-40:] + [head]
    ends = [tail] + [i + 1 for i in range(tail, len(low)) if low[i] in LEET and low[i + 1 : i + 2] != low[i]][:40]
    cuts = {(low[a:b], head - a, tail - a) for a in begins for b in ends if (a, b) != (head, tail) and a < b}
    return sorted(cuts)


def squeezed(word: str) -> str:
    """The word with every run of equal letters as one letter."""
    return REPEATED.sub(r"\1", word)


def spellings(word: str) -> list[str]:
    """The word as it stands and with its runs of equal letters as one or two letters.

    Words of many runs give all runs single and all double only; :class:`Listed` matches the rest.
    """
    found = DOUBLED.search(word)
    if not found:
        return [word]
    at = found.start()
    if not DOUBLED.search(word, at + 1):
        return [word, word[:at] + word[at + 1 :]]  # one run, of two letters; most words
    runs = [(c, min(2, len(list(g)))) for c, g in groupby(word)]
    if sum(n == 2 for _, n in runs) > 4:
        return list(dict.fromkeys([word, "".join(c * n for c, n in runs), squeezed(word)]))
    return list(dict.fromkeys([word, *map("".join, product(*([c * 2, c] if n == 2 else [c] for c, n in runs)))]))


@dataclass
class Restored:
    """Words of texts: per distinct chunk its words and its bare piece, chunk codes, first chunks, runs."""

    words: list[list[str]]
    pieces: list[str]
    codes: np.ndarray
    starts: np.ndarray
    runs: list[tuple[int, list[str]]]
    plain: list[bool]


def restored(texts: pa.Array, restore: Restorer, lookup: Listed | None = None) -> Restored:
    """Restored words of texts, cut at any blanks; chunks without a word are left out.

    With ``lookup``, words of letters that are like no listed word and no part of one are read as they
    stand: what they might be with fewer of their repeated letters is listed neither.
    Runs of three or more single-letter chunks, bare of the punctuation around them, are decoded
    together; they are (text, words) pairs, the last word being all of the run.
    """
    distinct, codes, starts = chunked(pc.replace_substring_regex(texts, BLANKS, " "))
    stems, stem_of, tails, tail_of = split_tails(distinct)
    # Tails with characters that stand for letters stay with their stems.
    whole = np.flatnonzero(np.fromiter((any(c in LEET for c in t) for t in tails), bool, len(tails))[tail_of])
    chunks = [*stems, *(stems[stem_of[i]] + tails[tail_of[i]] for i in whole.tolist())]
    low, plain = plain_words(chunks, lookup.known if lookup else frozenset())
    words = [[w] if p else restore.token(s) for s, w, p in zip(chunks, low, plain)]
    pieces = [w if p else bare(s) for s, w, p in zip(chunks, low, plain)]
    stem_of = stem_of.copy()
    stem_of[whole] = len(stems) + np.arange(len(whole))
    codes = stem_of[codes]
    # Chunks of mere punctuation stand between no letters.
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    full = (lengths > 0)[codes]
    starts = np.concatenate(([0], np.cumsum(full)))[starts]
    codes = codes[full]
    single = lengths == 1
    for i in np.flatnonzero(single).tolist():
        single[i] = pieces[i].isalnum() or pieces[i] in LEET
    single = single[codes]
    runs = []
    if single.any():
        # A run ends with its text.
        edge = np.zeros(len(codes) + 1, bool)
        edge[starts] = True
        at = np.flatnonzero(single)
        begin = at[(at == 0) | edge[at] | ~single[at - 1]]
        close = at[edge[at + 1] | ~np.append(single, False)[at + 1]] + 1
        for a, b in zip(begin[close - begin >= 3].tolist(), close[close - begin >= 3].tolist()):
            spaced = " ".join(pieces[c] for c in codes[a:b])
            owner = int(np.searchsorted(starts, a, side="right")) - 1
            found = restore.decode(spaced)
            runs.append((owner, [*(x for w in found.split() for x in spellings(w)), found.replace(" ", "")]))
    return Restored(words, pieces, codes, starts, runs, plain)


def plain_words(chunks: list[str], known: Set[str] = frozenset()) -> tuple[list[str], list[bool]]:
    """Lower-cased chunks, and which of them are letters without a doubled one: one reading each.

    If ``known`` is not empty, letters with doubled ones count as well unless they are in ``known``
    when every run of equal letters is one.
    """
    texts = pa.array(chunks, pa.string())
    lower = pc.ascii_lower(texts)
    letters = pc.ascii_is_alpha(texts).to_numpy(zero_copy_only=False)
    ends = np.frombuffer(lower.buffers()[1], np.int32)[: len(chunks) + 1]
    data = np.frombuffer(lower.buffers()[2], np.uint8) if len(chunks) and lower.buffers()[2] else np.zeros(0, np.uint8)
    twice = np.flatnonzero(data[1:] == data[:-1]) + 1
    owner = np.searchsorted(ends, twice, side="right") - 1
    inside = twice > ends[owner]  # both letters in one chunk
    doubled = np.zeros(len(chunks), bool)
    doubled[owner[inside]] = True
    plain = letters & ~doubled
    low = lower.to_pylist()
    if known:
        at = np.flatnonzero(letters & doubled)
        plain[at] = [squeezed(low[i]) not in known for i in at.tolist()]
    wide = ~pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(wide).tolist():
        low[i] = w = chunks[i].lower()
        plain[i] = w.isalpha() and (not DOUBLED.search(w) or bool(known) and squeezed(w) not in known)
    return low, plain.tolist()


def bare(chunk: str) -> str:
    """A chunk without the punctuation around it; a symbol that stands for a letter is kept if it is all."""
    low = chunk.lower()
    return low.strip(EDGE) or "".join(c for c in low if c in LEET)


class Listed:
    """Finds listed words among restored words, repeated letters and cut words included."""

    def __init__(self, words: Iterable[str], ordinary: Iterable[str] = ()):
        self.words = set(words)
        self.ordinary = set(ordinary)
        self.like: dict[str, list[str]] = defaultdict(list)
        for w in sorted(self.words, key=len, reverse=True):
            self.like[squeezed(w)].append(w)
        self.heads = {w[:i] for w in self.words for i in range(1, len(w))}
        self.rests = parts(self.words, 1)
        self.cut = self.heads | self.rests
        # Letters that may be listed, whole or in pieces, with every run of equal letters as one.
        self.known = frozenset(map(squeezed, self.words | self.cut))

    def of(self, words: list[str]) -> list[str]:
        """Listed words of one chunk: as spelled, else with fewer letters in its runs of equal ones."""
        found: dict[str, str] = {}
        for w in words:
            if w in self.words:
                hit = w
            elif DOUBLED.search(w) and (like := self.like.get(squeezed(w))):
                runs = [len(list(g)) for _, g in groupby(w)]
                hit = next((v for v in like if all(n >= len(list(g)) for n, (_, g) in zip(runs, groupby(v)))), None)
            else:
                continue
            # Readings of one chunk that differ in runs only are one word, the one with most letters.
            if hit and len(hit) > len(found.get(squeezed(hit), "")):
                found[squeezed(hit)] = hit
        return list(found.values())

    def of_all(self, text: Restored) -> list[list[str]]:
        """Listed words of each distinct chunk."""
        known, none = self.words, []
        return [
            (ws if ws[0] in known else none) if p else self.of(ws) for ws, p in zip(text.words, text.plain)
        ]

    def joined(self, text: Restored, restore: Restorer) -> Iterator[tuple[int, str]]:
        """Listed words that neighbouring chunks of one text make up: text, word."""
        options = []
        none: list[str] = []
        for ws, piece, plain in zip(text.words, text.pieces, text.plain):
            if plain:
                options.append(ws if piece in self.cut else none)
                continue
            more = [piece, *restore.decode(piece).split()] if len(piece) <= 3 and not piece.isalpha() else [piece]
            options.append([w for w in dict.fromkeys([*ws, *more]) if w in self.cut])
        heads, rests = np.zeros((2, len(options)), bool)
        for i, ws in enumerate(options):
            if ws:
                heads[i] = any(w in self.heads for w in ws)
                rests[i] = any(w in self.rests for w in ws)
        codes = text.codes
        if len(codes) < 2:
            return
        edge = np.zeros(len(codes) + 1, bool)
        edge[text.starts] = True
        at = np.flatnonzero(heads[codes[:-1]] & rests[codes[1:]] & ~edge[1:-1])
        owners = np.searchsorted(text.starts, at, side="right") - 1
        for p, owner in zip(at.tolist(), owners.tolist()):
            # What has been joined, and whether some piece is no ordinary word.
            open_ = {(w, self._odd(w, text.pieces[codes[p]])) for w in options[codes[p]] if w in self.heads}
            while open_:
                p += 1
                if p == len(codes) or edge[p]:
                    break
                piece = text.pieces[codes[p]]
                longer = {(a + w, odd or self._odd(w, piece)) for a, odd in open_ for w in options[codes[p]]}
                yield from ((owner, w) for w, odd in longer if odd and w in self.words)
                open_ = {x for x in longer if x[0] in self.heads}

    def _odd(self, word: str, piece: str) -> bool:
        return word != piece or word not in self.ordinary and word not in ("a", "i")


def parts(words: Iterable[str], least: int = 0) -> set[str]:
    """Pieces of words, from letter ``least`` on, the words themselves left out."""
    return {w[i:j] for w in words for i in range(least, len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w)}


@dataclass
class ToxicModel:
    costs: list[list[float]]
    base: float
    words: dict[str, float]  # probability that a document with the word is toxic, beyond the base
    ordinary: set[str] = field(default_factory=set)  # pieces of the words that are words of their own


def labelled_texts(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_labelled: int = 200_000,
) -> DataFrame:
    """Rows ``key, text, label`` of ``docs`` that ``labels`` covers; texts are never shuffled.

    Beyond ``max_labelled`` labelled ids a share of about that many is drawn by the hash of the id,
    so what is broadcast has a bound (an id and an integer for each).  An id with several labels
    takes the largest; null ids and null labels are left out.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(key).alias("_id")).agg(F.max(label).alias("_label"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(n)) < max_labelled)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    joined = texts.join(F.broadcast(known), F.col("_key") == F.col("_id"))
    return joined.select(F.col("_key").alias(key), F.col("_text").alias(text), F.col("_label").alias(label))


def fit_toxicity(
    docs: DataFrame,
    train: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    min_support: int = 8,
    min_share: float = 0.5,
    min_part: float = 0.01,
    max_words: int = 4096,
) -> ToxicModel:
    """Character model over all ``docs``, word model over all labelled rows of ``train``.

    ``max_words`` bounds the word model: the words of most toxic documents, of those in at least
    ``min_support`` toxic documents and a part ``min_part`` of all, with a toxic share of
    ``min_share`` or more.
    """
    costs = char_costs(char_counts(docs, text))

    def documents(batches: Iterator[pa.RecordBatch], lookup: Listed | None = None) -> Iterator[tuple[int, set[str], set[str]]]:
        """Label, words and listed words of documents."""
        restore = restorer(costs)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                text = restored(part.column("text"), restore)
                words, codes, starts = text.words, text.codes, text.starts
                extra: dict[int, set[str]] = {}
                for owner, found in text.runs:
                    extra.setdefault(owner, set()).update(found)
                hits = lookup.of_all(text) if lookup else []
                cut: dict[int, set[str]] = {}
                for owner, word in lookup.joined(text, restore) if lookup else ():
                    cut.setdefault(owner, set()).add(word)
                labels = part.column("label").to_pylist()
                for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                    chunks = np.unique(codes[a:b])
                    own = {w for c in chunks for w in words[c]} | extra.get(i, set())
                    found = {w for c in chunks for w in hits[c]} if lookup else set()
                    if lookup:
                        found.update(w for x in extra.get(i, ()) for w in lookup.of([x]))
                        found |= cut.get(i, set())
                    yield labels[i], {w for w in own if 2 <= len(w) <= 40}, found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Summed within the task: a row for each word and task, whatever the copies.
        total: Counter[str] = Counter()
        toxic: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            names = list(total)
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()), pa.array(list(total.values()), pa.int64())],
                ["word", "toxic", "n"],
            )

        for label, own, _ in documents(batches):
            total.update(own)
            if label:
                toxic.update(own)
            if len(total) > 500_000:
                yield flush()
                total.clear()
                toxic.clear()
        yield flush()

    rows = train.where(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("label"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not total["n"]:
        return ToxicModel(costs, 0.0, {})
    support = max(min_support, min_part * (total["toxic"] or 0))
    enough = (F.col("toxic") >= support) & (F.col("toxic") >= min_share * F.col("n"))
    sums = [F.sum("toxic").alias("toxic"), F.sum("n").alias("n")]
    counts = checkpointed(rows.mapInArrow(lean(count), "word string, toxic long, n long").groupBy("word").agg(*sums))
    named = counts.where(enough).orderBy(F.desc("toxic"), "word").limit(max_words).collect()
    listed = {r["word"] for r in named}
    # Pieces of listed words that many other documents hold as words are not cut from them.
    known = rows.sparkSession.createDataFrame([(w,) for w in sorted(parts(listed))], "word string")
    often = counts.where((F.col("n") - F.col("toxic") >= min_support) & (F.col("toxic") < min_share * F.col("n")))
    ordinary = {r["word"] for r in often.join(F.broadcast(known), "word", "left_semi").collect()}

    def listed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for label, own, hits in documents(batches, Listed(listed, ordinary)):
            if hit := sorted(hits):
                least = sorted(zlib.crc32(w.encode()) for w in own)[:SIGN]
                found.append((zlib.crc32(repr(least).encode()), label, hit))
            if len(found) >= 10_000:
                yield _batch(found)
                found = []
        yield _batch(found)

    hits = checkpointed(rows.mapInArrow(lean(listed_words), "sign long, label int, words array<string>"))
    # One document per signature and label: the first by its words.
    once = hits.groupBy("sign", "label").agg(F.min("words").alias("words")).persist()
    # Words that only accompany stronger ones are left out: in rounds, the strongest words among the
    # documents that no chosen word explains yet.
    share: dict[str, float] = {}
    while listed:
        left = once.where(~F.arrays_overlap("words", F.array(*map(F.lit, share)))) if share else once
        left = left.select("label", F.explode("words").alias("word"))
        left = left.groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
        found = [r for r in left.where(enough).collect() if r["word"] not in share]
        if not found:
            break
        most = max(r["toxic"] for r in found)
        for r in found:
            if r["toxic"] >= 0.7 * most:
                share[r["word"]] = (r["toxic"] + 0.1) / (r["n"] + 1.0)
    once.unpersist()
    known = hits.where(F.arrays_overlap("words", F.array(*map(F.lit, share)))) if share else hits.where("false")
    known = known.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    # Base: toxic share among training documents without any chosen word.
    rest = (total["toxic"] or 0) - (known["toxic"] or 0)
    return ToxicModel(costs, (rest + 0.1) / (total["n"] - known["n"] + 1.0), dict(sorted(share.items())), ordinary & parts(share))


def _batch(found: list[tuple[int, int, list[str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()),
            pa.array([f[2] for f in found], pa.list_(pa.string())),
        ],
        ["sign", "label", "words"],
    )


def score(
    docs: DataFrame, model: ToxicModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, score`` and ``n_words`` (distinct toxic words in the restored text); narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = restorer(model.costs)
        lookup = Listed(model.words, model.ordinary)
        number = {w: i for i, w in enumerate(model.words)}
        odds = np.log1p(-np.minimum(np.array([*model.words.values(), 0.0]), 0.999))
        rest = np.log1p(-min(model.base, 0.999))
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                text = restored(part.column("text"), restore, lookup)
                codes, starts = text.codes, text.starts
                toxic = [[number[w] for w in ws] for ws in lookup.of_all(text)]
                hit = np.fromiter(map(bool, toxic), bool, len(toxic))[codes]
                at = np.flatnonzero(hit)
                owner = np.searchsorted(starts, at, side="right") - 1
                found: list[set[int]] = [set() for _ in range(part.num_rows)]
                for i, c in zip(owner.tolist(), codes[at].tolist()):
                    found[i].update(toxic[c])
                for i, w in lookup.joined(text, restore):
                    found[i].add(number[w])
                for i, ws in text.runs:
                    found[i].update(number[w] for x in ws for w in lookup.of([x]))
                    # Where words begin in a run is a guess, so a listed word may begin anywhere.
                    found[i].update(n for w, n in number.items() if len(w) >= 4 and w in ws[-1])
                clean = [rest + sum(odds[w] for w in sorted(s)) for s in found]
                columns = [
                    part.column("key"), pa.array(-np.expm1(clean), pa.float64()),
                    pa.array([len(s) for s in found], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "score", "n_words"])

    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    schema = f"key {rows.schema['key'].dataType.simpleString()}, score double, n_words int"
    return rows.mapInArrow(lean(run), schema).withColumnRenamed("key", key)
