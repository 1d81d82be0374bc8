"""Hybrid model: rule outputs and lexical features through a linear support vector machine."""

from __future__ import annotations

import json
import random
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve import fixed
from namesieve.operators.features import (
    FeatureModel,
    FeatureOptions,
    TokenState,
    feature_columns,
    fit_features,
)
from namesieve.operators.lexicon import Lexicon
from namesieve.operators.rules import Profile, join_labels, profile, rule_matrix
from namesieve.operators.scoring import score
from namesieve.operators.svm import LinearModel, fit_squared_hinge
from namesieve.session import checkpointed


@dataclass(frozen=True)
class HybridModel:
    """Token tables, feature dictionary and coefficients; ``input`` is unique in every table here."""

    options: FeatureOptions
    state: TokenState
    features: FeatureModel
    svm: LinearModel

    def raw(self, matrix: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
        return feature_columns(matrix, self.state, self.options, mapping)

    def vectors(self, matrix: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
        return self.features.vectors(self.raw(matrix, mapping))

    def score_distinct(self, matrix: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
        """``input, margin, prediction``: the allow and deny lists override the model."""
        encoded = self.features.encode(self.raw(matrix, mapping))
        # Strings without a known feature still have the intercept.
        nothing = matrix.select("input", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("value"))
        margins = self.svm.margins(encoded.unionByName(nothing), "input")
        return matrix.select("input", "list_prediction").join(margins, "input", "left").select(
            "input", "margin", F.coalesce("list_prediction", label_of(F.col("margin"))).alias("prediction")
        )

    def predict_distinct(
        self,
        strings: DataFrame,
        lexicon: Lexicon,
        prof: Profile | None = None,
        mapping: DataFrame | None = None,
    ) -> DataFrame:
        """``input, prediction``.  The rule outputs feed several branches and are written once."""
        matrix = checkpointed(rule_matrix(strings, lexicon, prof))
        return self.score_distinct(matrix, mapping).select("input", "prediction")

    def predict(
        self,
        df: DataFrame,
        lexicon: Lexicon,
        prof: Profile | None = None,
        text: str = "input",
        mapping: DataFrame | None = None,
    ) -> DataFrame:
        """Label every row; each distinct string is scored once, before rows are split by frequency."""
        strings = df.select(F.coalesce(F.col(text), F.lit("")).alias("input"))
        labels = checkpointed(self.predict_distinct(strings, lexicon, prof, mapping))
        return join_labels(df, lambda wanted: wanted.join(labels, "input"), text)

    def save(self, spark: SparkSession, path: str) -> None:
        from namesieve.operators.stages import pipeline_of

        pipeline_of(self).write().overwrite().save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "HybridModel":
        from namesieve.operators.stages import load_pipeline, model_of

        return model_of(load_pipeline(path))


def label_of(margin: Column) -> Column:
    return F.when(margin > 0, fixed.GEN).otherwise(fixed.SPE)


def options_json(options: FeatureOptions) -> str:
    return json.dumps(asdict(options))


def options_of(text: str) -> FeatureOptions:
    raw = json.loads(text)
    raw["rules"], raw["tag_ngrams"] = tuple(raw["rules"]), tuple(raw["tag_ngrams"])
    return FeatureOptions(**raw)


@dataclass(frozen=True)
class Training:
    """Merged training rows and what was learnt from them before any model.

    ``merged`` are ``input, label, weight, rows``: rows of one string and label are merged by adding
    their weights, which leaves the weighted loss unchanged.  Strings decided by the allow or deny list
    count for the token frequencies only.
    """

    merged: DataFrame
    kept: DataFrame  # input, rows
    matrix: DataFrame
    state: TokenState
    raw: DataFrame

    @classmethod
    def prepare(
        cls,
        train: DataFrame,
        lexicon: Lexicon,
        terms: DataFrame,
        top_level: DataFrame,
        options: FeatureOptions,
        prof: Profile | None = None,
        weighted: bool = True,
        mapping: DataFrame | None = None,
    ) -> "Training":
        merged = checkpointed(merge_rows(train, weighted))
        strings = merged.groupBy("input").agg(F.sum("rows").alias("rows"))
        matrix = checkpointed(rule_matrix(merged, lexicon, prof))
        kept = checkpointed(strings.join(matrix.where("list_prediction IS NULL").select("input"), "input"))
        state = TokenState.fit(strings, terms, top_level, options, kept, mapping, "rows")
        open_ = matrix.where("list_prediction IS NULL")
        raw = checkpointed(feature_columns(open_, state, options, mapping).join(kept, "input"))
        return cls(merged, kept, matrix, state, raw)

    def examples(self, features: FeatureModel) -> DataFrame:
        """``input, features, target, weight``."""
        return features.vectors(self.raw).join(self.merged, "input").select(
            "input", "features", "weight", F.when(F.col("label") == fixed.GEN, 1).otherwise(-1).alias("target")
        )


def merge_rows(train: DataFrame, weighted: bool = True) -> DataFrame:
    """``input, label, weight, rows`` of ``input, label, numdocs``; missing weights are 1."""
    weight = F.coalesce(F.col("numdocs").cast("double"), F.lit(1.0)) if weighted else F.lit(1.0)
    by_class = F.when(F.col("label") == fixed.GEN, fixed.CLASS_WEIGHT["GEN"]).otherwise(
        fixed.CLASS_WEIGHT["SPE"]
    )
    text = F.coalesce("input", F.lit("")).alias("input")
    return train.groupBy(text, "label").agg(F.sum(weight * by_class).alias("weight"), F.count("*").alias("rows"))


def fit_hybrid(
    train: DataFrame,
    lexicon: Lexicon,
    terms: DataFrame,
    top_level: DataFrame,
    options: FeatureOptions | None = None,
    prof: Profile | None = None,
    weighted: bool = True,
    cost: float = 1.0,
    tolerance: float = 1e-6,
    max_iter: int = 50,
    mapping: DataFrame | None = None,
) -> HybridModel:
    """Train on ``input, label, numdocs`` until the gradient is ``tolerance`` times the first one."""
    options = options or FeatureOptions()
    data = Training.prepare(train, lexicon, terms, top_level, options, prof, weighted, mapping)
    features = fit_features(data.raw, options, "rows")
    svm = fit_squared_hinge(data.examples(features), cost, tolerance, max_iter)
    return HybridModel(options, data.state, features, svm)


def weighted_score(
    model: HybridModel,
    gold: DataFrame,
    lexicon: Lexicon,
    prof: Profile | None = None,
    beta: float = 1.0,
) -> DataFrame:
    """Weighted scores on ``input, label, numdocs``; rows of one string and label are merged."""
    merged = gold.groupBy("input", "label").agg(F.sum("numdocs").alias("numdocs"))
    predicted = model.predict_distinct(gold, lexicon, prof)
    return score(merged.join(predicted, "input"), weight="numdocs", beta=beta)


def random_options(n: int, seed: int = 0, rules: Iterable[int] = range(26)) -> list[tuple[FeatureOptions, float]]:
    """``n`` seeded points of the search space: feature toggles, bins, rule mask, cost."""
    rng = random.Random(seed)
    rules = tuple(rules)
    points = []
    for _ in range(n):
        coin = lambda: rng.random() < 0.5
        chosen = tuple(r for r in rules if coin()) or rules[:1]
        options = FeatureOptions(
            rare_words=coin(),
            min_word_freq=coin(),
            max_word_freq=coin(),
            word_list=coin(),
            word_list_top=coin(),
            top_level_word=coin(),
            n_bins=rng.choice((2, 3, 4)),
            rules=chosen,
        )
        points.append((options, 2.718281828459045 ** rng.uniform(0, 5)))
    return points
