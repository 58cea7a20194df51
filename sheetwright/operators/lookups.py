"""Lookup operators: exact and approximate search, positions, cells by address.

Exact search is an equi-join on a normalised key against the table reduced to
its first row for each key. Approximate search stops before the first key that
is greater; on the running maximum of the keys, which never falls, that is the
last row not above the target, so it is an as-of join whether or not the keys
are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a lookup table up to which it is sent to every task.
BROADCAST_ROWS = 20_000


#: Numbers that differ by less are equal.
TOLERANCE = 1e-9


def lookup_exact(left: DataFrame, target: str, table: DataFrame, key: str, order: str, values: list[str], numeric: bool = True) -> DataFrame:
    """Adds ``values`` of the first row of ``table`` (by ``order``) whose key equals ``target``; null and #N/A if none.

    Numbers are equal within ``TOLERANCE``, text without case. A number's cell of
    that width and the two beside it hold all keys equal to it, so a row of the
    table stands in three cells and a row of ``left`` looks into one.
    """
    own = F.col(key).cast("double") if numeric else F.upper(F.col(key).cast("string"))
    first = table.where(F.col(key).isNotNull()).groupBy(own.alias("lookup_key")).agg(F.min(F.struct(F.col(order).alias("o"), F.struct(*values).alias("row"))).alias("lookup_row"))
    if numeric:
        cell = lambda x: F.floor(x / TOLERANCE).cast("double")
        cells = F.array_distinct(F.array(*[cell(F.col("lookup_key")) + k for k in (-1.0, 0.0, 1.0)]))
        listed = F.array_sort(F.collect_list(F.struct(F.col("lookup_row")["o"].alias("o"), "lookup_key", F.col("lookup_row")["row"].alias("row"))))
        near = first.select(F.explode(cells).alias("lookup_cell"), "lookup_key", "lookup_row").groupBy("lookup_cell").agg(listed.alias("lookup_near"))
        x = left[target].cast("double")
        joined = left.join(near, cell(x) == F.col("lookup_cell"), "left")
        found = F.get(F.filter("lookup_near", lambda c: F.abs(c["lookup_key"] - F.col(target).cast("double")) < TOLERANCE), F.lit(0))["row"]
    else:
        joined = left.join(first, F.upper(left[target].cast("string")) == F.col("lookup_key"), "left")
        found = F.col("lookup_row")["row"]
    return joined.select(*left.columns, *[found[v].alias(v) for v in values], F.when(found.isNull(), F.lit("#N/A")).alias("lookup_error"))


def lookup_near(left: DataFrame, target: str, table: DataFrame, key: str, order: str, values: list[str], descending: bool = False) -> DataFrame:
    """Adds ``values`` of the row before the first key of ``table`` (by ``order``) that is greater than ``target``.

    descending: before the first key that is smaller.
    """
    sign = -1.0 if descending else 1.0
    steps = Window.orderBy(order)  # a lookup table is a sheet's range
    reach = table.select((sign * F.max(sign * F.col(key).cast("double")).over(steps)).alias("lookup_reach"), F.col(order).alias("lookup_order"), F.struct(*values).alias("lookup_row"))
    last = reach.groupBy("lookup_reach").agg(F.max_by("lookup_row", "lookup_order").alias("lookup_row"))
    last = last.withColumn("lookup_next", F.lead("lookup_reach").over(Window.orderBy(sign * F.col("lookup_reach"))))
    x = left[target].cast("double")
    low, high = F.col("lookup_reach") * sign, F.col("lookup_next") * sign
    inside = (x * sign >= low) & (F.col("lookup_next").isNull() | (x * sign < high))
    if last.count() <= BROADCAST_ROWS:
        joined = left.join(F.broadcast(last), inside, "left")
        return joined.select(*left.columns, *[F.col("lookup_row")[v].alias(v) for v in values], F.when(F.col("lookup_row").isNull(), F.lit("#N/A")).alias("lookup_error"))
    return _near_by_range(left, x * sign, last.select((F.col("lookup_reach") * sign).alias("at"), "lookup_row"), values)


def _near_by_range(left: DataFrame, x: Column, steps: DataFrame, values: list[str]) -> DataFrame:
    """The as-of join for large tables: both sides are cut at quantiles of the keys; each part starts with the row before it."""
    cuts = sorted(set(steps.approxQuantile("at", [k / 64 for k in range(1, 64)], 0.01)))
    part = lambda c: F.size(F.filter(F.array(*[F.lit(v) for v in cuts]), lambda v: v <= c))
    table = steps.withColumn("part", part(F.col("at")))
    ends = table.groupBy("part").agg(F.max_by(F.struct("at", "lookup_row"), "at").alias("end"))
    carried = ends.select(F.explode(F.sequence(F.col("part") + 1, F.lit(len(cuts)))).alias("part"), "end").where(f"part <= {len(cuts)}")
    carried = carried.groupBy("part").agg(F.max_by("end", F.col("end")["at"]).alias("end")).select("part", "end.*")
    rows = table.select("part", "at", "lookup_row").unionByName(carried.select("part", "at", "lookup_row"))
    probes = left.select(F.struct(*left.columns).alias("row"), x.alias("at")).withColumn("part", part(F.col("at")))
    both = rows.select("part", "at", "lookup_row", F.lit(None).cast(probes.schema["row"].dataType).alias("row"), F.lit(0).alias("kind"))
    both = both.unionByName(probes.select("part", "at", F.lit(None).cast(rows.schema["lookup_row"].dataType).alias("lookup_row"), "row", F.lit(1).alias("kind")))
    before = Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    done = both.withColumn("found", F.last("lookup_row", ignorenulls=True).over(before)).where("kind = 1")
    return done.select("row.*", *[F.col("found")[v].alias(v) for v in values], F.when(F.col("found").isNull(), F.lit("#N/A")).alias("lookup_error"))


def match_exact(left: DataFrame, target: str, vector: DataFrame, value: str, position: str, numeric: bool = True) -> DataFrame:
    """Adds the smallest 1-based ``position`` of an equal value."""
    return lookup_exact(left, target, vector.withColumn("match_position", F.col(position)), value, position, ["match_position"], numeric)


def index_cells(left: DataFrame, row: str, col: str, cells: DataFrame) -> DataFrame:
    """Adds the value of ``cells`` (row, col, value) at a 1-based address; outside the grid #REF!, blank inside it null."""
    size = cells.agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    at = cells.select((F.col("row") + 1).alias("index_row"), (F.col("col") + 1).alias("index_col"), F.col("value").alias("index_value"))
    joined = left.join(at, (left[row] == at["index_row"]) & (left[col] == at["index_col"]), "left").crossJoin(F.broadcast(size))  # one row
    inside = F.col(row).between(1, F.col("last_row") + 1) & F.col(col).between(1, F.col("last_col") + 1)
    return joined.select(*left.columns, "index_value", F.when(~inside, F.lit("#REF!")).alias("lookup_error"))
