"""Detection on a stream: lines carry no state, so the batch expressions run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.operators.detect import THRESHOLD, entities, with_entities
from docveil.operators.registry import DETECTORS, Detector
from docveil.sources.text import lines_of


def stream_entities(texts: DataFrame, detectors: tuple[Detector, ...] = DETECTORS, threshold: float = THRESHOLD) -> DataFrame:
    """Entities of a stream of (doc_id, text), placed in their lines: start and end are
    line_start and line_end, as a document's offsets and numbers need all its lines."""
    lines = lines_of(texts).withColumn("offset", F.lit(0).cast("long"))
    return entities(with_entities(lines, detectors, threshold))
