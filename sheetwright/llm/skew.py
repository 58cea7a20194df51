"""Joins on keys of which a few may hold a large share of the rows.

``attach`` counts the rows of each key first. Keys with more than one in
``HOT_KEYS`` of all rows, of which there are ``HOT_KEYS`` at most, are split:
their rows are dealt to as many parts as their share demands, and the other
side's row is repeated for each part. Only the list of these keys, bounded by
its definition, is known to the driver and sent out.

Tables of up to ``SMALL_ROWS`` rows, which one task reads easily, are not split.

Edge cases: rows with a null key match nothing and go, as in any inner join;
without a hot key, or without rows, this is a plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is split if it has more than one in so many rows.
HOT_KEYS = 500

#: Rows that a task may read for one key.
SMALL_ROWS = 200_000


def attach(rows: DataFrame, groups: DataFrame, key: str, by: str, at_most: int | None = None) -> DataFrame:
    """The inner join of ``rows`` and ``groups`` (one row for each ``key``); ``by``: a column that differs within a key.

    at_most: a bound of the rows, where one is known.
    """
    if at_most is not None and at_most <= SMALL_ROWS:
        return rows.join(groups, key)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    if not total or most <= SMALL_ROWS or most * HOT_KEYS <= total:
        return rows.join(groups, key)
    hot = {r[key]: -(-r["n"] * HOT_KEYS // total) for r in counts.where(F.col("n") * HOT_KEYS > total).collect()}
    spark = rows.sparkSession
    parts = F.broadcast(spark.createDataFrame(list(hot.items()), f"{key} {dict(rows.dtypes)[key]}, parts long"))
    dealt = rows.join(parts, key, "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1)))).drop("parts")
    repeated = groups.join(parts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.hint("merge").join(repeated, [key, "part"]).drop("part")  # sent out whole, one side would leave the parts of a key in one task
