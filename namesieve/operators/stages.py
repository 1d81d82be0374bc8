"""The learnt parts as pipeline stages that save and load with a ``PipelineModel``.

Stages work on a table of distinct strings, column ``input``; each adds its columns.  Fitted tables are
kept as DataFrames and written as Parquet beside the parameters of their stage; nothing of them passes
through the driver.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsReadable,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.operators.features import FeatureModel, TokenState, feature_columns, fit_features
from namesieve.operators.learning import HybridModel, label_of, options_json, options_of
from namesieve.operators.lexicon import Lexicon
from namesieve.operators.rules import RULE_COLUMNS, profile, profile_v1, rule_matrix
from namesieve.operators.svm import LinearModel, fit_squared_hinge
from namesieve.session import checkpointed


class TableWriter(MLWriter):
    """Parameters as every stage writes them, and the tables of the stage as Parquet."""

    def __init__(self, stage: "TableStage"):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.stage, path, spark, extraMetadata={"fitted": self.stage.fitted()})
        for name, table in self.stage.tables().items():
            table.write.mode("overwrite").parquet(f"{path}/tables/{name}")


class TableReader(MLReader):
    def __init__(self, cls: type["TableStage"]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Any:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        stage = self.cls.restore(spark, metadata["fitted"], lambda name: spark.read.parquet(f"{path}/tables/{name}"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class TableStage(MLWritable, MLReadable):
    """A stage whose state is tables and a few numbers."""

    def tables(self) -> dict[str, DataFrame]:
        raise NotImplementedError

    def fitted(self) -> dict:
        return {}

    @classmethod
    def restore(cls, spark: SparkSession, fitted: dict, table: Any) -> Any:
        raise NotImplementedError

    def write(self) -> TableWriter:
        return TableWriter(self)

    @classmethod
    def read(cls) -> TableReader:
        return TableReader(cls)


class HasOptions(Params):
    """Feature options as JSON, so that they are stored like any other parameter."""

    options: Param[str] = Param(Params._dummy(), "options", "feature options as JSON", TypeConverters.toString)

    def feature_options(self):
        return options_of(self.getOrDefault(self.options))


class HasRows(Params):
    rows: Param[str] = Param(
        Params._dummy(), "rows", "column with the training rows of a string", TypeConverters.toString
    )

    def rows_column(self) -> str | None:
        return self.getOrDefault(self.rows) if self.isSet(self.rows) else None


class RuleColumns(TableStage, Transformer):
    """Adds the rule outputs and ``list_prediction`` of each string."""

    generation: Param[int] = Param(Params._dummy(), "generation", "rule generation, 1 or 2", TypeConverters.toInt)

    def __init__(self, terms: DataFrame | None = None, generation: int = 2):
        super().__init__()
        self.terms = terms
        self._lexicon: Lexicon | None = None
        self._set(generation=generation)

    def tables(self) -> dict[str, DataFrame]:
        return {"terms": self.terms.select("list", "term")}

    @classmethod
    def restore(cls, spark, fitted, table) -> "RuleColumns":
        return cls(table("terms"))

    @property
    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon.compile(self.terms.select("list", "term"))
        return self._lexicon

    def _transform(self, dataset: DataFrame) -> DataFrame:
        prof = profile_v1() if self.getOrDefault(self.generation) == 1 else profile()
        matrix = checkpointed(rule_matrix(dataset, self.lexicon, prof))
        return dataset.join(matrix.select("input", "list_prediction", *RULE_COLUMNS), "input")


class RawFeaturesModel(TableStage, Model, HasOptions):
    """Adds the raw feature columns of each string."""

    def __init__(self, state: TokenState | None = None):
        super().__init__()
        self.state = state

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self.state, name) for name in TokenState.TABLES}

    @classmethod
    def restore(cls, spark, fitted, table) -> "RawFeaturesModel":
        return cls(TokenState(**{name: table(name) for name in TokenState.TABLES}))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        matrix = dataset.select("input", "list_prediction", *RULE_COLUMNS)
        raw = feature_columns(matrix, self.state, self.feature_options()).drop("list_prediction")
        # The raw features name the rules that are silent, so they replace the rule columns.
        added = [c for c in raw.columns if c != "input"]
        return dataset.drop(*added).join(raw, "input")


class RawFeatures(Estimator, HasOptions, HasRows):
    """Learns the token tables from the strings that no list decides, frequencies from all."""

    def __init__(self, terms: DataFrame, top_level: DataFrame, options: str, rows: str | None = None):
        super().__init__()
        self.terms, self.top_level = terms, top_level
        self._set(options=options)
        if rows:
            self._set(rows=rows)

    def _fit(self, dataset: DataFrame) -> RawFeaturesModel:
        kept = dataset.where("list_prediction IS NULL")
        state = TokenState.fit(
            dataset, self.terms, self.top_level, self.feature_options(), kept, rows=self.rows_column()
        )
        return RawFeaturesModel(state)._set(options=self.getOrDefault(self.options))


class SparseFeaturesModel(TableStage, Model, HasOptions):
    """Adds ``features``: size, indices and values of each string."""

    def __init__(self, features: FeatureModel | None = None):
        super().__init__()
        self.features = features

    def tables(self) -> dict[str, DataFrame]:
        return {"vocabulary": self.features.vocabulary}

    def fitted(self) -> dict:
        return {
            "edges": self.features.edges, "size": self.features.size, "n_rows": self.features.n_rows,
            "options": options_json(self.features.options),
        }

    @classmethod
    def restore(cls, spark, fitted, table) -> "SparseFeaturesModel":
        options = options_of(fitted["options"])
        return cls(FeatureModel(options, fitted["edges"], table("vocabulary"), fitted["size"], fitted["n_rows"]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.join(self.features.vectors(dataset), "input", "left")


class SparseFeatures(Estimator, HasOptions, HasRows, DefaultParamsReadable, DefaultParamsWritable):
    """Learns bin edges and the dictionary from the strings that no list decides."""

    @keyword_only
    def __init__(self, *, options: str | None = None, rows: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> SparseFeaturesModel:
        raw = checkpointed(dataset.where("list_prediction IS NULL"))
        found = fit_features(raw, self.feature_options(), self.rows_column())
        return SparseFeaturesModel(found)._set(options=self.getOrDefault(self.options))


class SquaredHingeModel(TableStage, Model):
    """Adds ``margin`` and ``prediction``; the word lists override the model."""

    def __init__(self, linear: LinearModel | None = None):
        super().__init__()
        self.linear = linear

    def tables(self) -> dict[str, DataFrame]:
        return {"weights": self.linear.weights}

    def fitted(self) -> dict:
        return {n: getattr(self.linear, n) for n in ("iterations", "gradient_norm", "first_norm")}

    @classmethod
    def restore(cls, spark, fitted, table) -> "SquaredHingeModel":
        return cls(LinearModel(table("weights"), **fitted))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        entries = F.arrays_zip(F.col("features")["indices"].alias("id"), F.col("features")["values"].alias("value"))
        long = dataset.select("input", F.inline_outer(entries).alias("id", "value"))
        joined = dataset.join(self.linear.margins(long, "input"), "input", "left")
        return joined.withColumn("prediction", F.coalesce("list_prediction", label_of(F.col("margin"))))


class SquaredHinge(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``features, target, weight`` of the strings that no list decides."""

    cost: Param[float] = Param(Params._dummy(), "cost", "factor of the loss", TypeConverters.toFloat)
    tolerance: Param[float] = Param(
        Params._dummy(), "tolerance", "share of the first gradient to stop at", TypeConverters.toFloat
    )
    maxIter: Param[int] = Param(Params._dummy(), "maxIter", "most Newton steps", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, cost: float = 1.0, tolerance: float = 1e-6, maxIter: int = 50):
        super().__init__()
        self._setDefault(cost=1.0, tolerance=1e-6, maxIter=50)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SquaredHingeModel:
        examples = dataset.where("list_prediction IS NULL").select("features", "target", "weight")
        numbers = (self.getOrDefault(p) for p in (self.cost, self.tolerance, self.maxIter))
        return SquaredHingeModel(fit_squared_hinge(examples, *numbers))


def hybrid_pipeline(
    terms: DataFrame,
    top_level: DataFrame,
    options: str,
    rows: str | None = None,
    cost: float = 1.0,
    tolerance: float = 1e-6,
    generation: int = 2,
) -> Pipeline:
    """Rules, raw features, dictionary and linear model; fits ``input, target, weight`` and ``rows``."""
    chosen = {"options": options} | ({"rows": rows} if rows else {})
    return Pipeline(
        stages=[
            RuleColumns(terms, generation), RawFeatures(terms, top_level, options, rows),
            SparseFeatures(**chosen), SquaredHinge(cost=cost, tolerance=tolerance),
        ]
    )


def pipeline_of(model: HybridModel, terms: DataFrame | None = None, generation: int = 2) -> PipelineModel:
    """A fitted model as stages; with ``terms`` the rules are part of it."""
    text = options_json(model.options)
    raw = RawFeaturesModel(model.state)._set(options=text)
    sparse = SparseFeaturesModel(model.features)._set(options=text)
    rules = [RuleColumns(terms, generation)] if terms is not None else []
    return PipelineModel([*rules, raw, sparse, SquaredHingeModel(model.svm)])


def model_of(pipeline: PipelineModel) -> HybridModel:
    raw, sparse, linear = pipeline.stages[-3:]
    return HybridModel(sparse.features.options, raw.state, sparse.features, linear.linear)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
