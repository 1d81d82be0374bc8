"""Feature columns of distinct strings, and the distributed dictionary that numbers them.

Features are rows ``(input, grp, term)``.  The fitted state is a table, ``grp, term, df, id``: how many
training rows have the feature, and a dense number by group and term.  Encoding is a join with that
table, vectors are built in one aggregation.  No vocabulary passes through the driver; the only
values that do are the bin edges, a few for each binned column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve import fixed
from namesieve.functions.shape import char_len, freq_all_caps, freq_capitals, word_len
from namesieve.operators.lexicon import measured, measured_side
from namesieve.operators.ranks import dense_positions, running_total
from namesieve.operators.rules import column_of, first_of
from namesieve.operators.tokens import (
    frequency_stats,
    placed,
    rank_bands,
    tag_sequences,
    tag_table,
    token_frequency,
    top_level_table,
    top_tokens,
    translate_tokens,
)
from namesieve.session import checkpointed

# Indicators of an integer column: its most frequent values.
TOP_VALUES = 20
# Terms that may stand in so many rows that their rows are not shuffled.
FREQUENT_TERMS = 10_000


@dataclass(frozen=True)
class FeatureOptions:
    """Which feature groups are built; defaults are the chosen configuration."""

    rare_words: bool = False
    min_word_freq: bool = True
    max_word_freq: bool = False
    word_list: bool = True
    word_list_top: bool = True
    top_level_word: bool = False
    all_caps: bool = False
    n_bins: int = 4
    rules: tuple[int, ...] = fixed.TUNED_RULES
    tag_ngrams: tuple[int, int] = (2, 5)
    top_words: int = 100
    top_level_words: int = 1000
    min_df_joined: int = 20
    min_df_ngrams: int = 10
    idf: bool = False

    @property
    def frequent(self) -> list[str]:
        """Integer columns with indicators of their frequent values."""
        extra = {"min_freq": self.min_word_freq, "max_freq": self.max_word_freq}
        return ["char_len", "word_len", *(c for c, wanted in extra.items() if wanted)]

    @property
    def binned(self) -> list[str]:
        return ["char_len", "word_len", "freq_capitals", "mean_freq", *(["freq_all_caps"] if self.all_caps else [])]

    @property
    def tagged(self) -> dict[str, tuple[tuple[int, int], bool]]:
        """Tag columns: the lengths of their n-grams, and whether whole sequences count too."""
        groups = {
            "tags": (self.word_list, self.tag_ngrams, True),
            "tags_top": (self.word_list_top, self.tag_ngrams, True),
            "tags_level": (self.top_level_word, (1, 3), False),
        }
        return {name: (lengths, joined) for name, (wanted, lengths, joined) in groups.items() if wanted}

    @property
    def rule_columns(self) -> list[str]:
        return [*(column_of(s) for s in self.rules), "rule_first"]

    def least_rows(self) -> dict[str, int]:
        """Training rows that a term of a group needs; other groups keep every term."""
        least = {}
        for column, (_, joined) in self.tagged.items():
            if joined:
                least |= {f"{column}.joined": self.min_df_joined, f"{column}.ngram": self.min_df_ngrams}
        return least


@dataclass(frozen=True)
class TokenState:
    """Token tables learnt from the training strings."""

    freq: DataFrame
    tags: DataFrame
    top: DataFrame
    top_level: DataFrame
    top_level_keep: DataFrame

    @classmethod
    def fit(
        cls,
        strings: DataFrame,
        terms: DataFrame,
        top_level: DataFrame,
        opts: FeatureOptions,
        kept: DataFrame | None = None,
        mapping: DataFrame | None = None,
        rows: str | None = None,
    ) -> "TokenState":
        """Learn from ``strings``; ``rows`` names a column with the training rows of each string.

        Frequencies count all strings.  The words that taggers keep are counted over ``kept``, the
        strings that are trained on, after abbreviations were translated.
        """
        freq = checkpointed(token_frequency(strings, rows=rows))
        rare = rank_bands(freq).where("band = 3").select("token") if opts.rare_words else None
        words = freq
        if kept is not None or mapping is not None:
            text = strings if kept is None else kept
            if mapping is not None:
                done = translate_tokens(text.select("input", F.col("input").alias("text")), mapping, "input", "text")
                text = text.join(done.select("input", "translated"), "input").withColumn("input", F.col("translated"))
            words = checkpointed(token_frequency(text, rows=rows))
        return cls(
            freq=freq,
            tags=checkpointed(tag_table(terms, rare)),
            top=checkpointed(top_tokens(words, opts.top_words).select("token")),
            top_level=checkpointed(top_level_table(terms, top_level)),
            top_level_keep=checkpointed(top_tokens(words, opts.top_level_words).select("token")),
        )

    TABLES = ("freq", "tags", "top", "top_level", "top_level_keep")

    def save(self, path: str) -> None:
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> "TokenState":
        return cls(**{n: spark.read.parquet(f"{path}/{n}") for n in cls.TABLES})


def feature_columns(
    matrix: DataFrame, state: TokenState, opts: FeatureOptions, mapping: DataFrame | None = None
) -> DataFrame:
    """Raw features per distinct string.  ``matrix`` comes from ``rule_matrix``.

    Strings are placed once; all that is joined or grouped by string then stays where it is.
    """
    rule_cols = [F.coalesce(column_of(s), F.lit("None")).alias(column_of(s)) for s in opts.rules]
    rows = placed(
        matrix.select("input", "list_prediction", *rule_cols, first_of(opts.rules).alias("rule_first")), "input"
    )
    strings = rows.select("input", F.col("input").alias("text"))
    if mapping is not None:
        strings = translate_tokens(
            strings.select("input", "text"), mapping, "input", "text", "translated", is_placed=True
        ).select("input", F.col("translated").alias("text"))
    text = F.col("text")
    out = strings.select(
        "input",
        char_len(text).cast("double").alias("char_len"),
        word_len(text).cast("double").alias("word_len"),
        freq_capitals(text).alias("freq_capitals"),
        freq_all_caps(text).alias("freq_all_caps"),
    )
    out = out.join(frequency_stats(strings, state.freq, "input", "text", is_placed=True), "input")
    if opts.word_list:
        out = out.join(
            tag_sequences(strings, state.tags, "input", "text", is_placed=True).select("input", "tags"), "input"
        )
    if opts.word_list_top:
        topped = tag_sequences(strings, state.tags, "input", "text", state.top, out="tags_top", is_placed=True)
        out = out.join(topped.select("input", "tags_top"), "input")
    if opts.top_level_word:
        level = tag_sequences(
            strings, state.top_level, "input", "text", state.top_level_keep, fixed.TAG_OTHER, "tags_level", True
        )
        out = out.join(level.select("input", "tags_level"), "input")
    return rows.join(out, "input")


# ---------------------------------------------------------------- bins


def exact_quantiles(
    df: DataFrame, columns: list[str], shares: list[float], rows: str | None = None
) -> dict[str, list[float]]:
    """Quantiles by linear interpolation, exact: running totals over the counts of distinct values.

    Nulls do not count.  A column without values has no quantiles.
    """
    weight = F.col(rows).cast("long") if rows else F.lit(1).cast("long")
    pairs = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    values = df.select(F.explode(pairs).alias("e"), weight.alias("n")).select("e.*", "n").where("x IS NOT NULL AND n > 0")
    counts = checkpointed(values.groupBy("col", "x").agg(F.sum("n").alias("n")))
    totals = {r.col: r.n for r in counts.groupBy("col").agg(F.sum("n").alias("n")).collect()}
    summed = running_total(counts, F.col("n"), "col", "x", out="upto")
    wanted, asks, base = {}, [], 0
    for i, name in enumerate(columns):
        wanted[name] = []
        for share in shares if i in totals else ():
            place = share * (totals[i] - 1)
            low = int(place)
            wanted[name].append((len(asks), place - low))
            for at in (low, min(low + 1, totals[i] - 1)):
                asks.append(F.min(F.when((F.col("col") == i) & (F.col("upto") > base + at), F.col("x"))))
        base += totals.get(i, 0)
    found = summed.agg(*[a.alias(f"q{j}") for j, a in enumerate(asks)]).first() if asks else ()
    return {c: [found[j] + (found[j + 1] - found[j]) * part for j, part in each] for c, each in wanted.items()}


def bin_edges(raw: DataFrame, columns: list[str], n_bins: int, rows: str | None = None) -> dict[str, list[float]]:
    """Inner edges of quantile bins; equal edges are one, and those at either end of the values none."""
    shares = [k / n_bins for k in range(n_bins + 1)]
    found = exact_quantiles(raw, columns, shares, rows)
    return {c: sorted({e for e in es if es[0] < e < es[-1]}) for c, es in found.items()}


def bin_of(value: Column, edges: list[float]) -> Column:
    """Number of edges up to ``value``: an edge belongs to the bin above it."""
    total = F.lit(0)
    for edge in edges:
        total = total + F.when(value >= edge, 1).otherwise(0)
    return total


# ---------------------------------------------------------------- features in long form


def named(group: str, term: Column) -> Column:
    return F.struct(F.lit(group).alias("grp"), term.cast("string").alias("term"))


def _grams(tags: Column, lengths: tuple[int, int]) -> Column:
    """Distinct n-grams of a tag array, joined by a space."""

    def of_length(n: int) -> Column:
        last = F.size(tags) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        # by position: a slice would copy its tags for every n-gram
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tags, i + k) for k in range(n)]))

    return F.array_distinct(F.concat(*[of_length(n) for n in range(lengths[0], lengths[1] + 1)]))


def feature_entries(opts: FeatureOptions, edges: dict[str, list[float]]) -> Column:
    """All features of a row as ``array<struct<grp, term>>``."""
    single = [named(f"{c}.value", F.col(c).cast("long")) for c in opts.frequent]
    single += [named(f"{c}.bin", bin_of(F.col(c), edges[c])) for c in opts.binned]
    single += [named(c, F.col(c)) for c in opts.rule_columns]
    single += [joined_tags(c) for c, (_, joined) in opts.tagged.items() if joined]
    lists = [tag_grams(c, lengths) for c, (lengths, _) in opts.tagged.items()]
    return F.concat(F.array(*single), *lists)


def joined_tags(column: str) -> Column:
    return named(f"{column}.joined", F.array_join(column, "_"))


def tag_grams(column: str, lengths: tuple[int, int]) -> Column:
    return F.transform(_grams(F.col(column), lengths), lambda g: named(f"{column}.ngram", g))


def feature_terms(raw: DataFrame, every: Column, *carried: str) -> DataFrame:
    """``input, grp, term`` and ``carried``: one row for each feature of ``every`` that a string has."""
    return raw.select("input", *carried, F.explode(every).alias("feature")).select("input", *carried, "feature.*")


def fit_vocabulary(
    terms: DataFrame, valued: list[str], least_rows: dict[str, int], rows: str | None = None
) -> DataFrame:
    """``grp, term, df, id``: kept terms with the number of training rows that have them.

    Counts are combined before the shuffle.  The groups ``valued`` keep their twenty most frequent
    integers, those of ``least_rows`` the terms of enough rows, all others every term.
    """
    counted = checkpointed(
        terms.groupBy("grp", "term").agg((F.sum(rows) if rows else F.count("*")).cast("long").alias("df"))
    )
    least = F.lit(1)
    for group, wanted in least_rows.items():
        least = F.when(F.col("grp") == group, wanted).otherwise(least)
    kept = counted.where(~F.col("grp").isin(*valued) & (F.col("df") >= least))
    for group in valued:
        own = counted.where(F.col("grp") == group)
        kept = kept.unionByName(own.orderBy(F.desc("df"), F.col("term").cast("long")).limit(TOP_VALUES))
    return dense_positions(kept, "grp", "term", out="id")


def encode(terms: DataFrame, vocabulary: DataFrame, *carried: str) -> DataFrame:
    """``input, id`` and ``carried`` of the known features; unknown ones are dropped.

    A vocabulary beyond the broadcast size still sends its most frequent terms to all tasks, so no
    task gets the rows of one hot term.
    """
    keys = ["grp", "term"]
    side, small = measured(vocabulary.select(*keys, "id"))
    if small:
        joined = terms.join(F.broadcast(side), keys)
    else:
        hot = F.broadcast(vocabulary.orderBy(F.desc("df"), "id").limit(FREQUENT_TERMS).select(*keys, "id"))
        rest = terms.join(hot.select(*keys), keys, "left_anti").join(side, keys)
        joined = terms.join(hot, keys).unionByName(rest)
    return joined.select("input", "id", *carried)


def sparse_vectors(encoded: DataFrame, size: int, *carried: str, value: Column | None = None) -> DataFrame:
    """``input, features``: size, sorted indices and values of each string, in one aggregation."""
    entry = F.struct("id", (F.lit(1.0) if value is None else value).alias("value"))
    built = encoded.groupBy("input", *carried).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return built.select(
        "input", *carried,
        F.struct(F.lit(size).cast("long").alias("size"), F.col("e.id").alias("indices"), F.col("e.value").alias("values")).alias("features"),
    )


@dataclass(frozen=True)
class FeatureModel:
    """Fitted features: bin edges, the numbered dictionary, and the rows they were learnt from."""

    options: FeatureOptions
    edges: dict[str, list[float]]
    vocabulary: DataFrame
    size: int
    n_rows: int

    def terms(self, raw: DataFrame, *carried: str) -> DataFrame:
        return feature_terms(raw, feature_entries(self.options, self.edges), *carried)

    def encode(self, raw: DataFrame, *carried: str) -> DataFrame:
        """``input, id, value``: 1 for each feature, or its inverse document frequency."""
        rows = encode(self.terms(raw, *carried), self.vocabulary, *carried)
        if not self.options.idf:
            return rows.withColumn("value", F.lit(1.0))
        weights = self.vocabulary.select("id", idf_weight(F.col("df"), self.n_rows).alias("value"))
        return rows.join(measured_side(weights), "id").select("input", "id", *carried, "value")

    def vectors(self, raw: DataFrame, *carried: str) -> DataFrame:
        """``input, features`` of every row of ``raw``; a string without a known feature has none."""
        return sparse_vectors(self.encode(raw, *carried), self.size, *carried, value=F.col("value"))

    def state(self) -> DataFrame:
        """Vocabulary and bin edges as ``grp, position, term, df``."""
        words = self.vocabulary.select("grp", F.col("id").alias("position"), "term", "df")
        spark = words.sparkSession
        rows = [(f"{c}.edge", i, e) for c, es in self.edges.items() for i, e in enumerate(es)]
        edges = spark.createDataFrame(rows, "grp string, position long, edge double")
        nothing = F.lit(None).cast("long").alias("df")
        return words.withColumn("edge", F.lit(None).cast("double")).unionByName(
            edges.select("grp", "position", F.lit(None).cast("string").alias("term"), nothing, "edge")
        )


def idf_weight(df: Column, n_rows: int) -> Column:
    return F.log((F.lit(1.0) + n_rows) / (df + 1)) + 1


def fit_features(raw: DataFrame, opts: FeatureOptions, rows: str | None = None) -> FeatureModel:
    """Learn edges and dictionary from raw features; ``rows`` counts the training rows of a string."""
    edges = bin_edges(raw, opts.binned, opts.n_bins, rows)
    carried = [rows] if rows else []
    terms = feature_terms(raw, feature_entries(opts, edges), *carried)
    vocabulary = checkpointed(fit_vocabulary(terms, [f"{c}.value" for c in opts.frequent], opts.least_rows(), rows))
    total = raw.agg(F.coalesce(F.sum(rows) if rows else F.count("*"), F.lit(0)).alias("n")).first().n
    return FeatureModel(opts, edges, vocabulary, vocabulary.count(), int(total))


def feature_overhead(df: DataFrame, column: str = "features") -> DataFrame:
    """Non-zeros per row (mean, population deviation), density and vector size."""
    nnz = F.size(F.filter(F.col(column)["values"], lambda v: v != 0))
    return df.select(nnz.alias("nnz"), F.col(column)["size"].alias("size")).agg(
        F.avg("nnz").alias("mean_nonzero"),
        F.stddev_pop("nnz").alias("std_nonzero"),
        (F.sum("nnz") / F.sum("size")).alias("density"),
        F.max("size").alias("n_features"),
    )
