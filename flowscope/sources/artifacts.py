"""Saved models."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.ml import Model, PipelineModel


def save_model(model: Model, path: str) -> None:
    """Save any fitted model; a bare one is stored as a pipeline of one stage."""
    pipeline = model if isinstance(model, PipelineModel) else PipelineModel([model])
    pipeline.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(path)
    except Exception as e:
        missing = "does not exist" in str(e) or (
            isinstance(e, PySparkException) and e.getCondition() == "PATH_NOT_FOUND")
        if missing:
            raise FileNotFoundError(f"no saved model at '{path}'") from e
        raise
