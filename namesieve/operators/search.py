"""Hyper-parameter search: many candidates over one shared feature table.

The rule matrix, the raw features and one long feature table with every variant (bins, taggers, rule
masks) are made once.  A candidate is a set of groups of that table and a cost; all candidates are
fitted and scored in the same passes.  Successive halving drops the weaker ones: each rung fits the
candidates left on a larger share of the training strings, the last one on all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve import fixed
from namesieve.operators import features as ft
from namesieve.operators.dataset import draw_order
from namesieve.operators.features import FeatureOptions, TokenState, feature_columns
from namesieve.operators.learning import label_of, merge_rows
from namesieve.operators.lexicon import BROADCAST_ROWS, Lexicon
from namesieve.operators.rules import SLOTS, Profile, rule_matrix
from namesieve.operators.svm import INTERCEPT, fit_weights
from namesieve.session import checkpointed

Point = tuple[FeatureOptions, float]
RARE = "_rare"
BINNED = ("char_len", "word_len", "freq_capitals", "freq_all_caps", "mean_freq")
VALUED = ("char_len", "word_len", "min_freq", "max_freq")


@dataclass(frozen=True)
class Space:
    """Everything that any of the points needs."""

    points: list[Point]

    def each(self, name: str) -> list:
        return sorted({getattr(o, name) for o, _ in self.points})

    @property
    def widest(self) -> FeatureOptions:
        """All columns; sizes that vary between points are not supported by one table."""
        first = self.points[0][0]
        for name in ("tag_ngrams", "top_words", "top_level_words", "min_df_joined", "min_df_ngrams", "idf"):
            if len(self.each(name)) > 1:
                raise ValueError(f"points differ in {name}")
        return replace(
            first, min_word_freq=True, max_word_freq=True, word_list=True, word_list_top=True, top_level_word=True,
            all_caps=True, rules=SLOTS,
        )

    def groups(self, options: FeatureOptions) -> list[str]:
        """Names of the groups of the shared table that a candidate uses."""
        tail = RARE if options.rare_words else ""
        names = [f"{c}.value" for c in options.frequent]
        names += [f"{c}.bin{options.n_bins}" for c in options.binned]
        names += [*options.rule_columns[:-1], mask_name(options.rules)]
        for column, (_, joined) in options.tagged.items():
            own = column if column == "tags_level" else column + tail
            names += [f"{own}.joined"] * joined + [f"{own}.ngram"]
        return names


def mask_name(rules: tuple[int, ...]) -> str:
    return "rule_first:" + "-".join(map(str, sorted(rules)))


@dataclass(frozen=True)
class Shared:
    """Token tables and fitted dictionary of all variants."""

    space: Space
    states: dict[bool, TokenState]
    edges: dict[int, dict[str, list[float]]]
    vocabulary: DataFrame | None = None

    def raw(self, matrix: DataFrame) -> DataFrame:
        """Raw features with the tags of both taggers, and the first rule of every mask."""
        base = self.space.widest
        out = None
        for rare, state in self.states.items():
            columns = feature_columns(matrix, state, replace(base, rare_words=rare))
            if out is None:
                out = columns.withColumnsRenamed({"tags": "tags_rare", "tags_top": "tags_top_rare"}) if rare else columns
            else:
                more = columns.select("input", F.col("tags").alias("tags_rare"), F.col("tags_top").alias("tags_top_rare"))
                out = out.join(more, "input")
        masks = {mask_name(o.rules): first_of_columns(o.rules) for o, _ in self.space.points}
        return out.withColumns(masks)

    def entries(self) -> Column:
        base = self.space.widest
        single = [ft.named(f"{c}.value", F.col(c).cast("long")) for c in VALUED]
        single += [
            ft.named(f"{c}.bin{n}", ft.bin_of(F.col(c), edges[c])) for n, edges in self.edges.items() for c in BINNED
        ]
        single += [ft.named(c, F.col(c)) for c in base.rule_columns[:-1]]
        single += [ft.named(m, F.col(f"`{m}`")) for m in sorted({mask_name(o.rules) for o, _ in self.space.points})]
        tails = [RARE if rare else "" for rare in self.states]
        single += [ft.joined_tags(c + t) for t in tails for c in ("tags", "tags_top")]
        lists = [ft.tag_grams(c + t, base.tag_ngrams) for t in tails for c in ("tags", "tags_top")]
        return F.concat(F.array(*single), *lists, ft.tag_grams("tags_level", (1, 3)))

    def least_rows(self) -> dict[str, int]:
        base = self.space.widest
        names = [c + (RARE if rare else "") for rare in self.states for c in ("tags", "tags_top")]
        return {f"{c}.joined": base.min_df_joined for c in names} | {f"{c}.ngram": base.min_df_ngrams for c in names}

    def encode(self, raw: DataFrame) -> DataFrame:
        return ft.encode(ft.feature_terms(raw, self.entries()), self.vocabulary).withColumn("value", F.lit(1.0))


def first_of_columns(rules: tuple[int, ...]) -> Column:
    """First rule of a mask over columns in which ``None`` is text."""
    given = [F.when(F.col(f"rule_{s:02d}") != "None", F.col(f"rule_{s:02d}")) for s in sorted(rules)]
    return F.coalesce(*given, F.lit("None"))


def weighted_f(margins: DataFrame, gold: DataFrame, lists: DataFrame, beta: float) -> dict[int, float]:
    """F score of GEN for each candidate; ``gold`` are ``input, label, numdocs``, merged."""
    told = F.coalesce("list_prediction", label_of(F.col("margin")))
    rows = margins.join(lists, "input").join(gold, "input").select("cand", "label", "numdocs", told.alias("told"))
    hit, given, wanted = (F.col("told") == "GEN") & (F.col("label") == "GEN"), F.col("told") == "GEN", F.col("label") == "GEN"
    sums = rows.groupBy("cand").agg(
        *[F.sum(F.when(c, F.col("numdocs")).otherwise(0.0)).alias(n) for c, n in ((hit, "tp"), (given, "p"), (wanted, "a"))]
    )
    out = {}
    for r in sums.collect():
        bottom = beta * beta * r.a + r.p
        out[r.cand] = (1 + beta * beta) * r.tp / bottom if bottom else 0.0
    return out


def search(
    train: DataFrame,
    dev: DataFrame,
    lexicon: Lexicon,
    terms: DataFrame,
    top_level: DataFrame,
    points: list[Point],
    prof: Profile | None = None,
    beta: float = 1.0,
    shares: tuple[float, ...] = (0.25, 0.5, 1.0),
    keep: float = 0.5,
    tolerance: float = 1e-6,
    max_iter: int = 50,
) -> tuple[Point, list[dict]]:
    """The point with the best weighted F score on ``dev``, and one record for each rung and candidate.

    ``shares`` end with 1.0, so the scores of the last rung are those of single fits on all rows.
    """
    if shares[-1] != 1.0:
        raise ValueError("the last rung takes all rows")
    space = Space(points)
    merged = checkpointed(merge_rows(train))
    strings = merged.groupBy("input").agg(F.sum("rows").alias("rows"))
    both = train.select("input").unionByName(dev.select("input"))
    matrix = checkpointed(rule_matrix(both, lexicon, prof))
    lists = matrix.select("input", "list_prediction")
    kept = checkpointed(strings.join(lists.where("list_prediction IS NULL").select("input"), "input"))
    states = {
        rare: TokenState.fit(strings, terms, top_level, replace(space.widest, rare_words=rare), kept, rows="rows")
        for rare in space.each("rare_words")
    }
    shared = Shared(space, states, {})
    raw = checkpointed(shared.raw(matrix))
    own = checkpointed(raw.join(kept, "input"))
    edges = {n: ft.bin_edges(own, list(BINNED), n, "rows") for n in space.each("n_bins")}
    shared = replace(shared, edges=edges)
    counted = ft.feature_terms(own, shared.entries(), "rows")
    vocabulary = checkpointed(ft.fit_vocabulary(counted, [f"{c}.value" for c in VALUED], shared.least_rows(), "rows"))
    shared = replace(shared, vocabulary=vocabulary)
    encoded = checkpointed(shared.encode(raw))
    gold = checkpointed(
        dev.groupBy(F.coalesce("input", F.lit("")).alias("input"), "label").agg(F.sum("numdocs").alias("numdocs"))
    )
    vectors = ft.sparse_vectors(encoded.join(kept.select("input"), "input"), vocabulary.count(), value=F.col("value"))
    target = F.when(F.col("label") == fixed.GEN, 1).otherwise(-1)
    draw = F.conv(F.substring(draw_order(F.col("input"), 0), 1, 8), 16, 10).cast("double") / float(1 << 32)
    examples = checkpointed(
        vectors.join(merged, "input").select("features", "weight", target.alias("target"), draw.alias("draw"))
    )
    left, trials = list(range(len(points))), []
    for rung, share in enumerate(shares):
        pairs = [(k, g) for k in left for g in space.groups(points[k][0])]
        wanted = F.broadcast(train.sparkSession.createDataFrame(pairs, "cand int, grp string"))
        members = vocabulary.join(wanted, "grp").select("cand", "id")
        drawn = examples.where(F.col("draw") < share)
        weights, stats = fit_weights(drawn, members, {k: points[k][1] for k in left}, tolerance, max_iter)
        scores = weighted_f(candidate_margins(encoded, checkpointed(weights)), gold, lists, beta)
        order = sorted(left, key=lambda k: (-scores.get(k, 0.0), k))
        for k in left:
            trials.append(
                {"rung": rung, "share": share, "candidate": k, "f_score": scores.get(k, 0.0), "iterations": stats[k][0]}
            )
        left = sorted(order[: max(1, round(len(order) * keep))]) if rung + 1 < len(shares) else [order[0]]
    return points[left[0]], trials


def candidate_margins(encoded: DataFrame, weights: DataFrame) -> DataFrame:
    """``input, cand, margin`` of every string for every candidate."""
    side = weights.where(F.col("id") != INTERCEPT).select("cand", "id", "weight")
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    constant = F.broadcast(weights.where(F.col("id") == INTERCEPT).select("cand", F.col("weight").alias("constant")))
    sums = encoded.join(side, "id").groupBy("input", "cand").agg(F.sum(F.col("weight") * F.col("value")).alias("sum"))
    return sums.join(constant, "cand").select("input", "cand", (F.col("sum") + F.col("constant")).alias("margin"))
