"""Style counts over a stream of texts: the counts of single texts are additive, so running sums per key are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.operators.style import style_core

SUMS = ["total_chars", "n_paragraphs", "paragraph_chars", "short_paragraphs", "n_sentences", "sentence_chars", "short_sentences", "long_sentences"]


def running_style(texts: DataFrame, key: str, text: str, event_time: str | None = None, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Sums per key, or per key and event-time window with a watermark for late rows.  Ratios are left to the reader."""
    keys = [key] + ([event_time] if event_time else [])
    if event_time:
        texts = texts.withWatermark(event_time, late)
    core = style_core(texts, keys, text)
    group = [F.col(key)] + ([F.window(event_time, window).alias("window")] if event_time else [])
    return core.groupBy(*group).agg(F.count(F.lit(1)).alias("n_texts"), *[F.sum(c).alias(c) for c in SUMS])
