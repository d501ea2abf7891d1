"""Annotation of a stream: a stateless join of events with a static model, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from varilume.operators.annotate import RICH, small_variants


def annotate_stream(events: DataFrame, transcripts: DataFrame, upstream_distance: int = 5000, downstream_distance: int = 5000) -> DataFrame:
    """Consequences of a streaming relation of literal alleles; each micro-batch is planned like a batch."""
    if not events.isStreaming:
        raise ValueError("events must be a stream; use annotate for a batch")
    return small_variants(events, transcripts, upstream_distance, downstream_distance).select(*RICH)
