"""Numbering of streams: lists and notes that grow.

An extension: the counters of the batch operators, kept as state. Items of a
key must arrive in order; late ones behind the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sheetwright.functions import numbering
from sheetwright.shipping import ship


def stream_note_labels(notes: DataFrame, key: str, order: str, custom: str, name: str = "Decimal") -> DataFrame:
    """Labels of notes as they arrive: a running number for each key; notes with their own mark use none."""
    ship(notes.sparkSession)
    kinds = dict(notes.dtypes)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        labels = []
        for mark in rows[custom]:
            if pd.isna(mark):
                n += 1
                labels.append(numbering.label(n, name))
            else:
                labels.append(mark)
        state.update((n,))
        yield pd.DataFrame({key: group[0], order: rows[order].to_numpy(), "label": labels})

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, label string"
    return notes.groupBy(key).applyInPandasWithState(step, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, kind: str, late: str = "10 minutes", length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts by kind over event-time windows; windows close once the watermark has passed them."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return events.withWatermark(at, late).groupBy(window, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n")
