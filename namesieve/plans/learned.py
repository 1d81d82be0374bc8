"""Queries of the learnt parts: features, linear model, search, kernel map, similar pairs.

The strings are the pieces of ``conversations``: those of the assistant count as GEN, weighted by turn.
Half of the conversations, by the hash of their id, are for training.
"""

from __future__ import annotations

from dataclasses import replace
from functools import wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.operators import features, kernel, learning, rules, similarity, stages
from namesieve.operators.features import FeatureOptions
from namesieve.operators.svm import fit_squared_hinge
from namesieve.plans import inputs
from namesieve.plans.inputs import table
from namesieve.plans.registry import query
from namesieve.session import checkpointed, ensure_checkpoint_dir

# All feature groups, and those of the model.
OPTIONS = FeatureOptions(max_word_freq=True, top_level_word=True, all_caps=True, min_df_joined=8, min_df_ngrams=5)
MODEL = FeatureOptions(min_df_joined=8, min_df_ngrams=5)
COST = 2e-4
TOLERANCE = 1e-9

# What was learnt from the tables of a folder; several queries of one application look at it.
_learnt: dict[tuple, object] = {}


def once(make):
    """Learn once for each application, folder and options; the tables are in the checkpoint folder."""

    @wraps(make)
    def get(spark: SparkSession, sf: str, options: FeatureOptions):
        key = (make.__name__, spark.sparkContext.applicationId, sf, options)
        if key not in _learnt:
            _learnt[key] = make(spark, sf, options)
        return _learnt[key]

    return get


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, input, label, numdocs, part`` of every piece of every turn."""
    talk = table(spark, sf, "conversations").select(
        "conv_id",
        F.when(F.col("role") == "assistant", "GEN").otherwise("SPE").alias("label"),
        (F.col("turn") + 1).cast("double").alias("numdocs"),
        F.explode(F.split("text", inputs.PIECE)).alias("input"),
    )
    draw = F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.lit("5")))
    return talk.withColumn("part", F.when(draw < "8", "train").otherwise("dev"))


def part_of(spark: SparkSession, sf: str, part: str) -> DataFrame:
    return lines(spark, sf).where(F.col("part") == part).select("input", "label", "numdocs")


@once
def _training(
    spark: SparkSession, sf: str, options: FeatureOptions
) -> tuple[learning.Training, features.FeatureModel]:
    lists = inputs.word_lists(spark, sf)
    data = learning.Training.prepare(
        part_of(spark, sf, "train"), inputs.lexicon(spark, sf), lists, lists.where("list = 'type'"), options
    )
    return data, features.fit_features(data.raw, options, "rows")


@once
def _fitted(spark: SparkSession, sf: str, options: FeatureOptions) -> learning.HybridModel:
    data, fitted = _training(spark, sf, options)
    return learning.HybridModel(options, data.state, fitted, fit_squared_hinge(data.examples(fitted), COST, TOLERANCE))


def _dev_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return checkpointed(rules.rule_matrix(part_of(spark, sf, "dev"), inputs.lexicon(spark, sf)))


@query
def tag_vocabulary(spark, sf):
    """The numbered terms of the tag columns with the training rows that have them."""
    return _training(spark, sf, OPTIONS)[1].vocabulary.where("grp LIKE 'tags%'")


@query
def frequent_values(spark, sf):
    """The twenty most frequent values of each integer column."""
    found = _training(spark, sf, OPTIONS)[1].vocabulary.where("grp LIKE '%.value'")
    return found.select("grp", F.col("term").cast("long").alias("value"), "df", "id")


@query
def fitted_state(spark, sf):
    """The whole dictionary and the bin edges."""
    state = _training(spark, sf, OPTIONS)[1].state()
    return state.select("grp", "position", "term", "df", F.round("edge", 9).alias("edge"))


@query
def feature_vectors(spark, sf):
    """The features of held-out strings, numbered by the dictionary of the training strings."""
    data, fitted = _training(spark, sf, OPTIONS)
    raw = features.feature_columns(_dev_matrix(spark, sf), data.state, OPTIONS)
    return fitted.vectors(raw).select(
        "input", F.size("features.indices").cast("long").alias("n"),
        F.md5(F.array_join("features.indices", ",")).alias("ids"),
    )


@query
def feature_overhead(spark, sf):
    data, fitted = _training(spark, sf, OPTIONS)
    row = features.feature_overhead(fitted.vectors(data.raw))
    return row.select(*[F.round(c, 9).alias(c) for c in ("mean_nonzero", "std_nonzero", "density")], "n_features")


@query
def idf_weights(spark, sf):
    """The scale of each feature: ln((1 + n) / (1 + df)) + 1."""
    fitted = _training(spark, sf, OPTIONS)[1]
    weight = features.idf_weight(F.col("df"), fitted.n_rows)
    return fitted.vocabulary.select("id", "grp", "term", F.round(weight, 9).alias("weight"))


@query
def svm_coefficients(spark, sf):
    """Coefficients at the optimum; the intercept has number -1."""
    model = _fitted(spark, sf, MODEL)
    named = model.svm.weights.join(model.features.vocabulary, "id", "left")
    return named.select("id", "grp", "term", (F.round("weight", 2) + 0.0).alias("weight"))


@query
def svm_gradient(spark, sf):
    """The gradient at the returned coefficients: nothing is left of it."""
    model = _fitted(spark, sf, MODEL)
    rounded = F.round(F.col("gradient") / model.svm.first_norm, 6) + 0.0
    return model.svm.weights.select("id", F.abs(rounded).alias("gradient"))


@query
def svm_predictions(spark, sf):
    """Labels of held-out strings; the word lists override the model."""
    done = _fitted(spark, sf, MODEL).score_distinct(_dev_matrix(spark, sf))
    return done.select("input", "prediction", (F.round("margin", 2) + 0.0).alias("margin"))


@query
def svm_quality(spark, sf):
    """Weighted scores of the model on held-out rows."""
    gold = part_of(spark, sf, "dev")
    row = learning.weighted_score(_fitted(spark, sf, MODEL), gold, inputs.lexicon(spark, sf))
    return row.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f_score", "support")])


@query
def stored_pipeline(spark, sf):
    """Labels of held-out strings by a pipeline of stages that was fitted, saved and loaded again."""
    lists = inputs.word_lists(spark, sf)
    merged = learning.merge_rows(part_of(spark, sf, "train")).withColumn(
        "target", F.when(F.col("label") == "GEN", 1).otherwise(-1)
    )
    # One row for each string: the side with the larger weight, and by how much.
    signed = merged.groupBy("input").agg(F.sum(F.col("target") * F.col("weight")).alias("sum"), F.sum("rows").alias("rows"))
    train = signed.where("sum <> 0").select("input", F.signum("sum").cast("int").alias("target"), F.abs("sum").alias("weight"), "rows")
    pipeline = stages.hybrid_pipeline(
        lists, lists.where("list = 'type'"), learning.options_json(MODEL), "rows", COST, TOLERANCE
    )
    path = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    pipeline.fit(checkpointed(train)).write().save(path)
    strings = part_of(spark, sf, "dev").select(F.coalesce("input", F.lit("")).alias("input")).distinct()
    done = stages.load_pipeline(path).transform(checkpointed(strings))
    return done.select("input", "prediction", (F.round("margin", 2) + 0.0).alias("margin"))


# ---------------------------------------------------------------- vectors


@query
def similar_pairs(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    best = similarity.similar_pairs(
        rows.where("label = 0"), rows.where("label <> 0"), 100, key="vec_id"
    )
    return best.select("query_id", "other_id", F.round("dot", 6).alias("dot"))


@query
def similar_strings(spark, sf):
    """Pairs of held-out strings of different labels with the most weighty common features."""
    data, fitted = _training(spark, sf, MODEL)
    weighted = features.FeatureModel(
        replace(MODEL, idf=True), fitted.edges, fitted.vocabulary, fitted.size, fitted.n_rows
    )
    raw = features.feature_columns(_dev_matrix(spark, sf), data.state, MODEL)
    sides = part_of(spark, sf, "dev").groupBy("input").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    vectors = checkpointed(weighted.vectors(raw).join(sides.where("lo = hi"), "input"))
    best = similarity.similar_pairs(
        vectors.where("lo = 'GEN'"), vectors.where("lo = 'SPE'"), 50, key="input", vector="features"
    )
    return best.agg(F.count("*").alias("n"), F.round(F.max("dot"), 6).alias("best"), F.round(F.min("dot"), 6).alias("last"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))


LANDMARKS = 50


def _kernel(spark, sf, kind):
    rows = _vectors(spark, sf)
    size = rows.agg(F.max(F.size("features"))).first()[0]
    return rows, kernel.fit_kernel(rows, size, key="vec_id", kind=kind, landmarks=LANDMARKS)


@query
def kernel_values(spark, sf):
    """Similarities of the embedding vectors with the landmarks, for two kernels."""
    out = None
    for kind in ("rbf", "poly"):
        rows, fitted = _kernel(spark, sf, kind)
        part = kernel.kernel_rows(rows, fitted, "vec_id").select(
            F.lit(kind).alias("kind"), "vec_id", "no", F.round("kernel", 6).alias("kernel")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def kernel_map(spark, sf):
    """Landmark similarities of the embedding vectors, times the inverse root of the landmarks' own."""
    rows, fitted = _kernel(spark, sf, "rbf")
    mapped = kernel.apply_kernel(rows, fitted, "vec_id")
    return mapped.select("vec_id", F.round(F.col("mapped")[0], 4).alias("first"))
