"""The per-story steps under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.events import stories_to_events
from ..sources.readers import STORY


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """Exploded events of story files as they arrive; stateless, so no watermark is needed."""
    return stories_to_events(spark.readStream.schema(STORY).json(path))
