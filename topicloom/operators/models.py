"""Training, keeping and applying models."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.joins import latest_per_key
from topicloom.session import path_exists, remove_path

SPLIT_SEED = 1234  # fixed value

MODEL_SCHEMA = ("name string, type string, category string, description string, path string, "
                "udf string, inputs string, updated timestamp, deleted boolean")


def split_sample(df: DataFrame, sample: int, seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows; ``sample`` is the training share in percent."""
    if not 0 < sample <= 100:
        raise ValueError("the sample is a percentage above 0")
    if sample == 100:
        return df, df.limit(0)
    train, held_out = df.randomSplit([sample / 100.0, 1 - sample / 100.0], seed=seed)
    return train, held_out


def train_naive_bayes(df: DataFrame, sample: int = 80, score: str = "held_out",
                      label: str = "label", features: str = "features"
                      ) -> tuple[Model, DataFrame]:
    """Train on a sample and score the held-out rows, or all rows."""
    train, held_out = split_sample(df, sample)
    model = NaiveBayes(labelCol=label, featuresCol=features).fit(train)
    return model, model.transform(df if score == "all" else held_out)


def naive_bayes_pipeline(label: str, features: Sequence[str], sample: int,
                         df: DataFrame) -> PipelineModel:
    """Same recipe on a plain table: text labels and numeric feature columns."""
    indexer = StringIndexer(inputCol=label, outputCol="label_index",
                            stringOrderType="alphabetAsc").fit(df)
    stages = [
        indexer,
        VectorAssembler(inputCols=list(features), outputCol="features"),
        NaiveBayes(labelCol="label_index", featuresCol="features"),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels),
    ]
    train, _ = split_sample(df, sample)
    return Pipeline(stages=stages).fit(train)


def train_program(df: DataFrame, fit: Callable[[DataFrame], Model]) -> Model:
    """Free-form training: any callable that returns a fitted model."""
    return fit(df)


def naive_bayes_sql(model: PipelineModel) -> tuple[list[str], str]:
    """Input names and the SQL expression that predicts as a fitted ``naive_bayes_pipeline`` does."""
    indexer, assembler, bayes, _ = model.stages
    if bayes.getOrDefault("modelType") != "multinomial":
        raise ValueError("only multinomial models can be said in SQL")
    inputs = assembler.getInputCols()
    pi, theta = bayes.pi.toArray(), bayes.theta.toArray()
    # Of equal scores the first class wins, as in the model.
    scores = [
        "struct({} AS score, {} AS place, {} AS label)".format(
            " + ".join([f"CAST({start!r} AS DOUBLE)", *(f"`{c}` * CAST({w!r} AS DOUBLE)" for c, w in zip(
                inputs, weights))]), -at, "'" + str(label).replace("\\", "\\\\").replace("'", "\\'") + "'")
        for at, (start, weights, label) in enumerate(zip(pi.tolist(), theta.tolist(), indexer.labels))]
    return inputs, f"array_max(array({', '.join(scores)})).label"


class Models:
    """Models kept below a shared root: one row per change, fitted pipelines beside it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.table = f"{root}/models"

    def _append(self, name: str, **values: object) -> None:
        row = {"name": name, "updated": datetime.now(timezone.utc), "deleted": False} | values
        columns = [c.split()[0] for c in MODEL_SCHEMA.split(", ")]
        data = [tuple(row.get(c) for c in columns)]
        self.spark.createDataFrame(data, MODEL_SCHEMA).write.mode("append").parquet(self.table)

    def save(self, name: str, model: PipelineModel, udf: str | None = None,
             inputs: Sequence[str] = (), **about: str) -> None:
        """Add a model, or replace the one of that name."""
        path = f"{self.root}/fitted/{name}"
        model.write().overwrite().save(path)
        self._append(name, path=path, udf=udf, inputs=json.dumps(list(inputs)), **about)

    def list(self) -> DataFrame:
        if not path_exists(self.spark, self.table):
            return self.spark.createDataFrame([], MODEL_SCHEMA)
        rows = self.spark.read.schema(MODEL_SCHEMA).parquet(self.table)
        return latest_per_key(rows, ["name"], ["updated"]).where(~F.col("deleted"))

    def delete(self, name: str) -> None:
        remove_path(self.spark, f"{self.root}/fitted/{name}")
        self._append(name, deleted=True)

    def load(self, name: str) -> PipelineModel:
        found = self.list().where(F.col("name") == name).select("path").first()
        if found is None:
            raise LookupError(f"no model named {name!r}")
        return PipelineModel.load(found["path"])

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """Apply a model to a table or a stream."""
        return self.load(name).transform(df)

    def register(self, name: str) -> str:
        """Make a model callable from SQL, in batch and stream queries, by its ``udf`` name (else its own name).

        It becomes a SQL function of its numeric inputs, so its calls are optimised like any expression.
        """
        found = self.list().where(F.col("name") == name).first()
        if found is None:
            raise LookupError(f"no model named {name!r}")
        called = found["udf"] or name
        inputs, body = naive_bayes_sql(PipelineModel.load(found["path"]))
        arguments = ", ".join(f"`{c}` DOUBLE" for c in inputs)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{called}`({arguments}) RETURNS STRING RETURN {body}")
        return called
