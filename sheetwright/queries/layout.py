"""Grid, interval and packing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetwright.operators import bands, grid, paging
from sheetwright.queries.registry import Registry, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

#: Parts as the cells of one grid per brand, eight columns wide, in key order.
_CELLS_SQL = "SELECT p_brand AS grid, ((row_number() OVER w - 1) // 8)::INT AS row, ((row_number() OVER w - 1) % 8)::INT AS col, 1 AS row_span, 1 AS col_span, p_partkey, p_size FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    p = table(spark, sf_dir, "part").withColumn("k", k)
    return p.select(F.col("p_brand").alias("grid"), F.floor(F.col("k") / 8).cast("int").alias("row"), (F.col("k") % 8).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), "p_partkey", "p_size")


_KEPT = ("grid", "row", "col", "p_partkey")


@_r.add(f"SELECT grid, col AS row, row AS col, p_partkey FROM ({_CELLS_SQL})")
def grid_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.transpose(_cells(spark, sf_dir)).select(*_KEPT)


@_r.add(f"WITH c AS ({_CELLS_SQL}) SELECT grid, row, (max(col) OVER (PARTITION BY grid) - col)::INT AS col, p_partkey FROM c")
def grid_flip_horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.flip_horizontal(_cells(spark, sf_dir)).select(*_KEPT)


@_r.add(f"WITH c AS ({_CELLS_SQL}) SELECT grid, (max(row) OVER (PARTITION BY grid) - row)::INT AS row, col, p_partkey FROM c")
def grid_flip_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.flip_vertical(_cells(spark, sf_dir)).select(*_KEPT)


@_r.add(f"SELECT grid, row - 1 AS row, col - 2 AS col, p_partkey FROM ({_CELLS_SQL}) WHERE row BETWEEN 1 AND 3 AND col BETWEEN 2 AND 5")
def grid_subgrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.subgrid(_cells(spark, sf_dir), 1, 2, 3, 4).select(*_KEPT)


@_r.add(f"""WITH c AS (SELECT grid, row, (col // 2 * 2)::INT AS col, 2 AS col_span, min(p_partkey) AS p_partkey FROM ({_CELLS_SQL}) GROUP BY ALL), i AS (SELECT grid, CASE WHEN row >= 2 THEN row + 1 ELSE row END AS row, CASE WHEN col >= 3 THEN col + 1 ELSE col END AS col, CASE WHEN col < 3 AND col + 2 > 3 THEN 3 ELSE 2 END AS col_span, p_partkey FROM c)
SELECT grid, CASE WHEN row > 0 THEN row - 1 ELSE row END AS row, col, col_span, p_partkey FROM i WHERE row <> 0""")
def grid_insert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _cells(spark, sf_dir).groupBy("grid", "row", (F.floor(F.col("col") / 2) * 2).cast("int").alias("col")).agg(F.min("p_partkey").alias("p_partkey"))
    cells = pairs.withColumns({"row_span": F.lit(1), "col_span": F.lit(2)})
    return grid.delete_row(grid.insert_column(grid.insert_row(cells, 2), 3), 0).select("grid", "row", "col", "col_span", "p_partkey")


_SPANS_SQL = f"SELECT grid, row * 2 AS row, col * 3 AS col, 1 + p_size % 2 AS row_span, 1 + p_size % 3 AS col_span, p_partkey FROM ({_CELLS_SQL})"


def _spanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("grid", (F.col("row") * 2).alias("row"), (F.col("col") * 3).alias("col"), (F.col("p_size") % 2 + 1).alias("row_span"), (F.col("p_size") % 3 + 1).alias("col_span"), "p_partkey")


@_r.add(f"""WITH c AS ({_SPANS_SQL}), r AS (SELECT *, unnest(range(row, row + row_span)) AS r FROM c) SELECT grid, r::INT AS row, unnest(range(col, col + col_span))::INT AS col, row AS root_row, col AS root_col FROM r""")
def grid_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.slots(_spanned(spark, sf_dir)).select("grid", "row", "col", "root_row", "root_col")


@_r.add(f"""WITH c AS ({_SPANS_SQL}), r AS (SELECT *, unnest(range(row, row + row_span)) AS r FROM c), s AS (SELECT grid, r, unnest(range(col, col + col_span)) AS k, row, col FROM r), m AS (SELECT grid, max(r) + 1 AS rows, max(k) + 1 AS cols FROM s GROUP BY 1),
 inside AS (SELECT a.grid, count(*) FILTER (WHERE b.r = a.r + 1 AND b.k = a.k) AS h, count(*) FILTER (WHERE b.k = a.k + 1 AND b.r = a.r) AS v FROM s a JOIN s b ON a.grid = b.grid AND a.row = b.row AND a.col = b.col GROUP BY 1)
SELECT grid, ((rows + 1) * cols + rows * (cols + 1))::BIGINT AS n_edges, (h + v)::BIGINT AS n_internal FROM m JOIN inside USING (grid)""")
def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = grid.edges(grid.slots(_spanned(spark, sf_dir)))
    return e.groupBy("grid").agg(F.count("*").alias("n_edges"), F.count_if("internal").alias("n_internal"))


def _rank_sql(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in grid.BORDER_RANKS.items()) + " END"


@_r.add(f"""WITH c AS (SELECT *, (p_size % 4) / 2.0 AS tl, CASE p_size % 3 WHEN 0 THEN 'Solid' WHEN 1 THEN 'Double' ELSE 'Dotted' END AS sl, (p_partkey % 4) / 2.0 AS tr, CASE p_partkey % 3 WHEN 0 THEN 'Dashed' WHEN 1 THEN 'Double' ELSE 'Inset' END AS sr FROM ({_CELLS_SQL})),
 n AS (SELECT *, lag(tr) OVER w AS nt, lag(sr) OVER w AS ns FROM c WINDOW w AS (PARTITION BY grid, row ORDER BY col))
SELECT grid, row, col, CASE WHEN nt IS NOT NULL AND (nt > tl + 0.01 OR (abs(nt - tl) <= 0.01 AND {_rank_sql('ns')} > {_rank_sql('sl')})) THEN nt ELSE tl END::DOUBLE AS thickness,
 CASE WHEN nt IS NOT NULL AND (nt > tl + 0.01 OR (abs(nt - tl) <= 0.01 AND {_rank_sql('ns')} > {_rank_sql('sl')})) THEN ns ELSE sl END AS style FROM n""")
def border_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda key, names: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % 3 + 1).cast("int"))
    border = lambda key, names: F.struct((F.col(key) % 4 / 2).cast("double").alias("thickness"), pick(key, names).alias("style"))
    own, other = border("p_size", ("Solid", "Double", "Dotted")), border("p_partkey", ("Dashed", "Double", "Inset"))
    cells = _cells(spark, sf_dir).withColumns({"border_left": own, "border_right": other, "border_top": own, "border_bottom": other})
    return grid.effective_borders(cells).select("grid", "row", "col", F.col("effective_left")["thickness"].alias("thickness"), F.col("effective_left")["style"].alias("style"))


@_r.add("""WITH e AS (SELECT event_id, event_id % 40 AS s, event_id % 5 AS n, event_id % 17 AS a, event_id % 4 AS r, event_id % 3 AS i, unnest([{'k': 'Default', 'x': 0, 'y': 0}, {'k': 'ShiftAtStart', 'x': 1, 'y': 0}, {'k': 'ExpandAtEnd', 'x': 0, 'y': 1}, {'k': 'ExpandBoth', 'x': 0, 'y': 1}, {'k': 'StrictInterior', 'x': 1, 'y': 0}]) AS f FROM events),
 b AS (SELECT *, least(s, a) + greatest(s - a - r, 0) + i * (CASE WHEN (s > a AND s >= a + r) OR (s = a AND r = 0 AND f.x = 1) THEN 1 ELSE 0 END) AS u,
  least(s + n, a) + greatest(s + n - a - r, 0) + i * (CASE WHEN (s + n > a AND s + n >= a + r) OR (s + n = a AND r = 0 AND f.y = 1) THEN 1 ELSE 0 END) AS v FROM e)
SELECT event_id, f.k AS affinity, CASE WHEN n > 0 THEN u WHEN a < s OR (a = s AND f.x = 1) THEN s + i - r ELSE s END AS start, CASE WHEN n > 0 THEN greatest(v - u, 0) ELSE 0 END AS count FROM b""")
def shift_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges, also empty ones, after an edit, under each affinity."""
    e = F.col("event_id")
    moved = [F.struct(F.lit(name).alias("affinity"), *[c.alias(k) for k, c in zip(("start", "count"), grid.shift_range(e % 40, e % 5, e % 17, e % 4, e % 3, name), strict=True)]) for name in grid.AFFINITIES]
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.array(*moved)).alias("m")).select("event_id", "m.*")


@_r.add("""WITH e AS (SELECT event_id, event_id % 30 AS s, event_id % 4 + 1 AS c, event_id % 11 AS a, event_id % 3 + 1 AS n, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 20 END AS t FROM events),
 o AS (SELECT *, CASE WHEN t = a THEN range(40) WHEN t > a THEN range(a) || range(a + n, t) || range(a, a + n) || range(t, 40) ELSE range(t) || range(a, a + n) || range(t, a) || range(a + n, 40) END AS ordered FROM e),
 p AS (SELECT *, list_transform(range(s, s + c), lambda x: list_position(ordered, x) - 1) AS places FROM o)
SELECT event_id, CASE WHEN places = range(list_min(places), list_min(places) + c) THEN list_min(places) ELSE s END AS start FROM p""")
def relocate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of one to four paragraphs; the SQL moves the paragraphs themselves."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", grid.relocate_range(e % 30, e % 4 + 1, e % 11, e % 3 + 1, F.when(e % 2 == 0, 0).otherwise(20)).alias("start"))


#: Lines of orders as obstacles on a page for each order; the orders themselves are lines of text.
def _obstacles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    top = F.col("l_linenumber") * 7.0
    kind = F.element_at(F.array(*map(F.lit, ("Side", "FloatLeft", "FloatRight", "Side"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    raw = li.select(F.col("l_orderkey").alias("page"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("order"), (F.col("l_quantity") * 4).alias("left"), top.alias("top"), (F.col("l_quantity") * 4 + 30).alias("right"), (top + 10).alias("bottom"), kind.alias("kind"), F.lit("Largest").alias("side"), F.lit(0.0).alias("least_room"))
    return bands.valid_obstacles(raw)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    return o.select("page", F.posexplode(F.array(*[F.lit(x) for x in (0.0, 12.5, 25.5, 40.0)])).alias("line", "top"), F.lit(5.0).alias("height"))


_BANDS_SQL = "WITH o AS (SELECT l_orderkey AS page, l_linenumber * 7.0 AS top, l_linenumber * 7.0 + 10 AS bottom FROM lineitem), l AS (SELECT o_orderkey AS page, unnest([0, 1, 2, 3]) AS line, unnest([0.0, 12.5, 25.5, 40.0]) AS top FROM orders)"


@_r.add(f"{_BANDS_SQL} SELECT l.page, l.line, count(*) AS n, min(o.bottom)::DOUBLE AS edge FROM l JOIN o ON l.page = o.page AND o.top < l.top + 5 - 0.001 AND o.bottom > l.top + 0.001 GROUP BY ALL")
def band_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = bands.intersecting(_lines(spark, sf_dir), _obstacles(spark, sf_dir)).groupBy("page", "line").agg(F.count("*").alias("n"))
    return met.join(bands.shallowest_edge(_lines(spark, sf_dir), _obstacles(spark, sf_dir)), ["page", "line"]).select("page", "line", "n", "edge")


@_r.add()
def band_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands and the widest free interval of every line; the tests hold both against a plain fold."""
    lines, obstacles = _lines(spark, sf_dir), _obstacles(spark, sf_dir)
    free = bands.widest(bands.free_intervals(lines, obstacles, 0.0, 240.0)).select("page", "line", F.col("band_left").alias("free_left"), F.col("band_width").alias("free_width"))
    return bands.compute_band(lines, obstacles, 0.0, 240.0).join(free, ["page", "line"], "left")


@_r.add()
def band_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.resolve_lines(_lines(spark, sf_dir), _obstacles(spark, sf_dir), 0.0, 240.0, least_width=150.0)


@_r.add("""WITH RECURSIVE c AS (SELECT p_brand AS sheet, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS col, (p_size * 6.0) AS width FROM part), r AS (SELECT sheet, col, width AS used, 0 AS run FROM c WHERE col = 0
 UNION ALL SELECT c.sheet, c.col, CASE WHEN r.used > 0 AND r.used + c.width > 400.01 THEN c.width ELSE r.used + c.width END, CASE WHEN r.used > 0 AND r.used + c.width > 400.01 THEN r.run + 1 ELSE r.run END FROM r JOIN c ON c.sheet = r.sheet AND c.col = r.col + 1)
SELECT sheet, run, min(col)::INT AS first, max(col)::INT AS last FROM r GROUP BY ALL""")
def sheet_column_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    col = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("col")
    columns = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), col, (F.col("p_size") * 6.0).alias("width"), F.lit(True).alias("used"))
    return paging.column_runs(columns, 400.0)


@_r.add("""WITH h AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS h FROM lineitem GROUP BY 1), f AS (SELECT l_orderkey, len(h) AS n, len(list_filter(list_transform(range(1, len(h) + 1), lambda i: list_sum(h[1:i])), lambda s: s <= 100.001)) AS fit FROM h),
 w AS (SELECT *, CASE WHEN n - fit < 2 THEN greatest(0, n - 2) ELSE fit END AS kept FROM f) SELECT l_orderkey, (CASE WHEN fit = n THEN fit WHEN kept < 2 THEN 0 ELSE kept END)::INT AS lines FROM w""")
def lines_that_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    h = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda x: x["l_quantity"]).alias("h"))
    return h.select("l_orderkey", paging.lines_that_fit(F.col("h"), F.lit(0), F.lit(100.0), F.lit(2), F.lit(2)).alias("lines"))


@_r.add()
def pages_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as blocks of documents: pages with breaks and keep rules."""
    o = table(spark, sf_dir, "orders")
    blocks = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("position"), (F.col("o_orderkey") % 40 + 5.0).alias("height"), (F.col("o_orderpriority") == "1-URGENT").alias("break_before"), (F.col("o_orderstatus") == "F").alias("keep_with_next"))
    return paging.paginate(blocks, 100.0)


@_r.add()
def balanced_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return paging.balance_columns(p.select(F.col("p_brand").alias("section"), F.col("p_partkey").alias("line"), (F.col("p_size") * 1.0).alias("height")), 3)


@_r.add()
def composed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return paging.compose_paragraphs(b.select(F.col("item_id").alias("doc_id"), F.lit(0).alias("p"), "text"), 40.0)


@_r.add("SELECT doc_id, CASE WHEN regexp_matches(text, '\\p{L}') THEN 2 WHEN regexp_matches(text, '[0-9]') THEN 3 ELSE 0 END AS direction FROM documents")
def text_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", paging.text_direction(F.coalesce("text", F.lit(""))).alias("direction"))


@_r.add(f"""WITH c AS ({_CELLS_SQL}), m AS (SELECT grid, col, max(p_size)::DOUBLE AS least, max(p_size * 2 + p_partkey % 10)::DOUBLE AS wanted FROM c GROUP BY ALL), t AS (SELECT *, sum(least) OVER (PARTITION BY grid) AS need, sum(wanted) OVER (PARTITION BY grid) AS want FROM m)
SELECT grid, col, round(CASE WHEN want <= 600 THEN wanted WHEN need >= 600 THEN least ELSE least + CASE WHEN want > need THEN (wanted - least) / (want - need) ELSE 0 END * (600 - need) END, 6) AS width FROM t""")
def column_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumns({"least": F.col("p_size").cast("double"), "wanted": (F.col("p_size") * 2 + F.col("p_partkey") % 10).cast("double")})
    return paging.column_extents(cells, 600.0).select("grid", "col", F.round("width", 6).alias("width"))


@_r.add(f"WITH c AS ({_CELLS_SQL}), f AS (SELECT * FROM c WHERE p_size % 3 = 0) SELECT grid AS sheet, row, col, (coalesce(lead(col) OVER (PARTITION BY grid, row ORDER BY col), 8) - 1)::INT AS free_until FROM f")
def text_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumnRenamed("grid", "sheet").withColumn("filled", F.col("p_size") % 3 == 0)
    return paging.overflow_columns(cells, 8).select("sheet", "row", "col", "free_until")


@_r.add()
def topology_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumns({"order": F.col("p_partkey"), "col": F.when(F.col("p_size") % 2 == 0, F.col("col")), "col_span": F.col("p_size") % 3 + 1, "row_span": F.col("p_size") % 2 + 1})
    return grid.place_cells(cells)
