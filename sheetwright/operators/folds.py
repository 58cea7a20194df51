"""Ordered folds over many small groups."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwright.shipping import ship


def fold_groups(df: DataFrame, keys: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs ``fold`` on each group of ``keys``. Groups share Arrow batches by a hash, so that a small one costs no exchange with Python of its own."""
    ship(df.sparkSession)
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop(columns="fold_part")
        made = [fold(part) for _, part in frame.groupby(keys, sort=False, dropna=False)]
        return pd.concat(made, ignore_index=True)[names] if made else pd.DataFrame(columns=names)

    return df.withColumn("fold_part", F.pmod(F.xxhash64(*keys), F.lit(parts))).groupBy("fold_part").applyInPandas(run, schema)
