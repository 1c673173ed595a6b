"""Scoring of new transfers with a fitted encoder and model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from transferlens.functions.columns import with_calendar
from transferlens.operators.features import FittedEncoder
from transferlens.schema import SCORING_REQUEST
from transferlens.sources.runlog import check_signature, load_signature, save_signature


def requests_table(spark: SparkSession, requests: list[dict]) -> DataFrame:
    """Request fields as a table; amounts given as text become numbers, missing fields are an error."""
    rows = []
    for request in requests:
        missing = [f.name for f in SCORING_REQUEST.fields if f.name not in request]
        if missing:
            raise ValueError(f"request lacks {missing}")
        fits = {T.StringType(): str, T.DoubleType(): float}
        rows.append(tuple(None if request[f.name] is None else fits[f.dataType](request[f.name]) for f in SCORING_REQUEST.fields))
    return spark.createDataFrame(rows, SCORING_REQUEST)


def as_requests(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Any table with the request columns, cast to the request schema; ``day`` comes from
    ``timestamp`` when it is not given."""
    if "day" not in df.columns and "timestamp" in df.columns:
        df = with_calendar(df)
    missing = [f.name for f in SCORING_REQUEST.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"requests lack {missing}")
    return df.select(*(keep or []), *[F.col(f.name).cast(f.dataType) for f in SCORING_REQUEST.fields])


@dataclass
class Scorer:
    """Encoder and model, loaded once and used for any number of rows, batch or stream."""

    encoder: FittedEncoder
    model: Model

    def score(self, requests: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns, ``prediction``, both class probabilities and the class's name."""
        keep = keep or []
        predicted = self.model.transform(self.encoder.transform_to_vector(requests, keep))
        p = vector_to_array("probability")
        prediction = F.col("prediction").cast("int")
        return predicted.select(
            *keep,
            prediction.alias("prediction"),
            p[0].alias("p_not_fraud"),
            p[1].alias("p_fraud"),
            F.when(prediction == 1, "Fraudulent").otherwise("Non-Fraudulent").alias("verdict"),
        )

    def save(self, path: str, example: DataFrame | None = None) -> None:
        """Encoder, model and, given example requests, the signature that requests must match."""
        self.encoder.save(f"{path}/encoder")
        self.model.write().overwrite().save(f"{path}/model")
        if example is not None:
            save_signature(example, self.score(example.limit(0)), f"{path}/signature")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Scorer":
        return Scorer(FittedEncoder.load(spark, f"{path}/encoder"), load_model(f"{path}/model"))

    @staticmethod
    def check(requests: DataFrame, path: str) -> None:
        check_signature(requests, load_signature(requests.sparkSession, f"{path}/signature"))


def load_model(path: str) -> Model:
    """Any saved model; its metadata tells the class."""
    return DefaultParamsReader.loadParamsInstance(path, _context())


def _context():
    return SparkSession.active()
