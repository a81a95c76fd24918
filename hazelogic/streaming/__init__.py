"""Scoring on streams: a fitted model is a projection, so the same code runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hazelogic.operators import infer


def score_stream(stream: DataFrame, model: infer.Model, family: str = "probability") -> DataFrame:
    """The stream with `strengths` and `label`; stateless, so no watermark is needed."""
    scored = stream.withColumn("strengths", infer.firing(model, family, columns=stream.columns))
    return scored.withColumn("label", infer.classify(scored["strengths"], model.labels))
