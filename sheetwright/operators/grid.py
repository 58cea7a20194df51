"""Structural operators on table grids.

A grid is a table of root cells: ``grid, row, col, row_span, col_span`` and any
other columns. Every operator returns a new cell set; none needs more than
arithmetic on coordinates, a window or an exchange on the grid's key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwright.operators.folds import fold_groups

#: Most rows, columns, slots of a table and slots of a cell in the topology fold.
MOST_ROWS, MOST_COLS, MOST_SLOTS, MOST_CELL_SLOTS = 65_536, 1_024, 2_000_000, 100_000

#: Ranks of border styles.
BORDER_RANKS = {"Double": 8, "Solid": 7, "Dashed": 6, "Dotted": 5, "Ridge": 4, "Outset": 3, "Groove": 2, "Inset": 1}

SIDES = ("left", "top", "right", "bottom")


def _extent(cells: DataFrame) -> DataFrame:
    return cells.groupBy("grid").agg(F.max(F.col("row") + F.col("row_span")).alias("n_rows"), F.max(F.col("col") + F.col("col_span")).alias("n_cols"))


def slots(cells: DataFrame, order: str = "order") -> DataFrame:
    """One row for each covered coordinate; where cells overlap the first in ``order`` holds it."""
    if order not in cells.columns:
        cells = cells.withColumn(order, F.struct("row", "col"))
    spread = cells.select("grid", F.col("row").alias("root_row"), F.col("col").alias("root_col"), order, F.explode(F.expr("sequence(row, row + row_span - 1)")).alias("row"), "col", "col_span")
    spread = spread.select("grid", "root_row", "root_col", order, "row", F.explode(F.expr("sequence(col, col + col_span - 1)")).alias("col"))
    held = spread.groupBy("grid", "row", "col").agg(F.min_by(F.struct("root_row", "root_col"), order).alias("root"))
    return held.select("grid", "row", "col", F.col("root")["root_row"].alias("root_row"), F.col("root")["root_col"].alias("root_col"), ((F.col("row") != F.col("root")["root_row"]) | (F.col("col") != F.col("root")["root_col"])).alias("is_continuation"))


def _swap(cells: DataFrame, pairs: list[tuple[str, str]]) -> dict[str, Column]:
    """Columns that trade places, as far as they are there (borders, paddings)."""
    out = {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            for c in cells.columns:
                if c.endswith(f"_{x}") and f"{c[: -len(x)]}{y}" in cells.columns:
                    out[c] = F.col(f"{c[: -len(x)]}{y}")
    return out


def transpose(cells: DataFrame) -> DataFrame:
    """Rows and columns trade places, with their spans; left trades with top and right with bottom."""
    out = {"row": F.col("col"), "col": F.col("row"), "row_span": F.col("col_span"), "col_span": F.col("row_span")} | _swap(cells, [("left", "top"), ("right", "bottom")])
    return cells.select(*[out.get(c, F.col(c)).alias(c) for c in cells.columns])


def _with_extent(cells: DataFrame) -> DataFrame:
    return cells.join(_extent(cells), "grid")


def flip_horizontal(cells: DataFrame) -> DataFrame:
    out = {"col": F.col("n_cols") - F.col("col") - F.col("col_span")} | _swap(cells, [("left", "right")])
    return _with_extent(cells).select(*[out.get(c, F.col(c)).alias(c) for c in cells.columns])


def flip_vertical(cells: DataFrame) -> DataFrame:
    out = {"row": F.col("n_rows") - F.col("row") - F.col("row_span")} | _swap(cells, [("top", "bottom")])
    return _with_extent(cells).select(*[out.get(c, F.col(c)).alias(c) for c in cells.columns])


def subgrid(cells: DataFrame, row: int, col: int, n_rows: int, n_cols: int) -> DataFrame:
    """The window's cells with clipped spans, counted from its corner; formulas and values stay behind."""
    end_row, end_col = F.least(F.col("row") + F.col("row_span"), F.lit(row + n_rows)), F.least(F.col("col") + F.col("col_span"), F.lit(col + n_cols))
    first_row, first_col = F.greatest("row", F.lit(row)), F.greatest("col", F.lit(col))
    hit = cells.where((end_row > first_row) & (end_col > first_col))
    out = {"row": first_row - row, "col": first_col - col, "row_span": end_row - first_row, "col_span": end_col - first_col}
    cut = {"top": F.col("row") < row, "left": F.col("col") < col, "bottom": F.col("row") + F.col("row_span") > row + n_rows, "right": F.col("col") + F.col("col_span") > col + n_cols}
    for c in cells.columns:
        for side, test in cut.items():
            if c.startswith("border_") and c.endswith(f"_{side}"):
                out[c] = F.when(~test, F.col(c))
    return hit.select(*[out.get(c, F.col(c)).alias(c) for c in cells.columns if c not in ("formula", "value")])


def _insert(cells: DataFrame, at: int, line: str) -> DataFrame:
    span = f"{line}_span"
    moved = F.when(F.col(line) >= at, F.col(line) + 1).otherwise(F.col(line))
    wider = F.when((F.col(line) < at) & (F.col(line) + F.col(span) > at), F.col(span) + 1).otherwise(F.col(span))
    return cells.withColumns({line: moved, span: wider})


def _delete(cells: DataFrame, at: int, line: str) -> DataFrame:
    span = f"{line}_span"
    kept = cells.where(~((F.col(line) == at) & (F.col(span) == 1)))
    covers = (F.col(line) <= at) & (F.col(line) + F.col(span) > at)
    return kept.withColumns({line: F.when(F.col(line) > at, F.col(line) - 1).otherwise(F.col(line)), span: F.when(covers, F.col(span) - 1).otherwise(F.col(span))})


def insert_row(cells: DataFrame, at: int) -> DataFrame:
    """Cells from ``at`` on move down; cells that straddle it grow."""
    return _insert(cells, at, "row")


def insert_column(cells: DataFrame, at: int) -> DataFrame:
    return _insert(cells, at, "col")


def delete_row(cells: DataFrame, at: int) -> DataFrame:
    """Cells of the row go, straddling ones shrink; merged ones that begin there begin at what follows."""
    return _delete(cells, at, "row")


def delete_column(cells: DataFrame, at: int) -> DataFrame:
    return _delete(cells, at, "col")


def move_row(cells: DataFrame, source: int, target: int) -> DataFrame:
    """The row ends up at ``target``; those between close up."""
    r = F.col("row")
    step = F.when(r == source, F.lit(target)).when((r > source) & (r <= target), r - 1).when((r < source) & (r >= target), r + 1).otherwise(r)
    return cells.withColumn("row", step)


def merge_cells(cells: DataFrame, row: int, col: int, n_rows: int, n_cols: int) -> DataFrame:
    """One cell over a block: it keeps the root's columns, takes all paragraphs and loses formula and value."""
    inside = (F.col("row") >= row) & (F.col("row") < row + n_rows) & (F.col("col") >= col) & (F.col("col") < col + n_cols)
    whole = Window.partitionBy("grid", inside)
    root = inside & (F.col("row") == row) & (F.col("col") == col)
    out = {"row_span": F.when(root, n_rows).otherwise(F.col("row_span")), "col_span": F.when(root, n_cols).otherwise(F.col("col_span"))}
    if "n_paragraphs" in cells.columns:
        out["n_paragraphs"] = F.when(root, F.sum("n_paragraphs").over(whole)).otherwise(F.col("n_paragraphs"))
    for c in ("formula", "value"):
        if c in cells.columns:
            out[c] = F.when(~root, F.col(c))
    return cells.withColumns(out).where(~inside | root)


def split_cell(cells: DataFrame) -> DataFrame:
    """Merged cells fall apart into their coordinates; all but the root are empty."""
    spread = cells.withColumn("split_at", F.explode(F.expr("flatten(transform(sequence(0, row_span - 1), r -> transform(sequence(0, col_span - 1), c -> struct(r as r, c as c))))")))
    root = (F.col("split_at")["r"] == 0) & (F.col("split_at")["c"] == 0)
    out = {"row": F.col("row") + F.col("split_at")["r"], "col": F.col("col") + F.col("split_at")["c"], "row_span": F.lit(1), "col_span": F.lit(1)}
    for c in cells.columns:
        if c not in ("grid", "row", "col", "row_span", "col_span"):
            out[c] = F.when(root, F.col(c))
    return spread.withColumns(out).select(*cells.columns)


def distinct_by_line(slots_: DataFrame, line: str) -> DataFrame:
    """The distinct cells of each row (or column), in the order they are met."""
    other = "col" if line == "row" else "row"
    return slots_.groupBy("grid", line, "root_row", "root_col").agg(F.min(other).alias("first"))


def edges(slots_: DataFrame) -> DataFrame:
    """Every segment of the grid's lines: orientation, line, place, the cells on both sides, and whether it lies inside a cell.

    Slots and segments meet in one aggregate: a table of slots is much larger than the cells it comes from, which
    the planner doesn't know when it looks for what to broadcast. A large grid's lines are dealt out before they spread.
    """
    parts = int(slots_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = slots_.groupBy("grid").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    ways = F.array(*[F.struct(F.lit(v).alias("vertical"), F.col(lines).alias("lines"), F.col(places).alias("places")) for v, lines, places in ((False, "n_rows", "n_cols"), (True, "n_cols", "n_rows"))])
    every = size.select("grid", F.explode(ways).alias("way")).select("grid", "way.vertical", "way.places", F.explode(F.sequence(F.lit(0), F.col("way.lines"))).alias("line"))
    every = every.repartition(parts, "grid", "vertical", "line").select("grid", "vertical", "line", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))

    def side(vertical: bool, line: str, place: str, before: bool) -> Column:
        cell = [F.when(F.lit(of == before), F.col(c)).alias(f"{name}_{c}") for name, of in (("before", True), ("after", False)) for c in ("root_row", "root_col")]
        return F.struct(F.lit(vertical).alias("vertical"), (F.col(line) + int(before)).alias("line"), F.col(place).alias("place"), *cell)

    sides = F.array(*[side(v, line, place, before) for v, line, place in ((False, "row", "col"), (True, "col", "row")) for before in (True, False)])
    seen = slots_.where("grid is not null and row is not null and col is not null").select("grid", F.explode(sides).alias("s")).select("grid", "s.*")
    met = every.withColumn("real", F.lit(True)).unionByName(seen, allowMissingColumns=True).groupBy("grid", "vertical", "line", "place")
    met = met.agg(F.max("real").alias("real"), *[F.max(c).alias(c) for c in ("before_root_row", "before_root_col", "after_root_row", "after_root_col")]).where("real")
    cell = lambda name: F.when(F.col(f"{name}_root_row").isNotNull(), F.struct(F.col(f"{name}_root_row").alias("root_row"), F.col(f"{name}_root_col").alias("root_col"))).alias(name)
    out = met.select("grid", F.when(F.col("vertical"), "vertical").otherwise("horizontal").alias("orientation"), "line", "place", cell("before"), cell("after"))
    return out.withColumns({"internal": F.coalesce(F.col("before") == F.col("after"), F.lit(False)), "perimeter": F.col("before").isNull() | F.col("after").isNull()})


def seams(edges_: DataFrame, right_to_left: bool = False) -> DataFrame:
    """Edges whose borders collapse: not inside a cell; a tie belongs to the cell before, or after in right-to-left tables."""
    owner = F.coalesce("after", "before") if right_to_left else F.coalesce("before", "after")
    vertical = F.col("orientation") == "vertical"
    return edges_.where(~F.col("internal")).withColumn("tie_owner", F.when(vertical, owner).otherwise(F.coalesce("before", "after")))


def stronger_border(own: Column, other: Column) -> Column:
    """The winner of two borders (thickness, style): thicker by more than 0.01, then the style's rank, then one's own."""
    rank = lambda b: F.coalesce(F.try_element_at(F.create_map(*[x for k, v in BORDER_RANKS.items() for x in (F.lit(k), F.lit(v))]), b["style"]), F.lit(0))
    thicker = other["thickness"] > own["thickness"] + 0.01
    close = F.abs(other["thickness"] - own["thickness"]) <= 0.01
    return F.when(own.isNull(), other).when(other.isNull(), own).when(thicker | (close & (rank(other) > rank(own))), other).otherwise(own)


def effective_borders(cells: DataFrame) -> DataFrame:
    """Adds the arbitrated border of every side; ``cells``: single-slot cells with border_<side> structs."""
    by_col, by_row = Window.partitionBy("grid", "row").orderBy("col"), Window.partitionBy("grid", "col").orderBy("row")

    def neighbour(name: str, step: int, window, line: str) -> Column:
        there = F.lag(line, -step).over(window) == F.col(line) + step
        return F.when(there, F.lag(name, -step).over(window))

    out = {
        "effective_left": stronger_border(F.col("border_left"), neighbour("border_right", -1, by_col, "col")),
        "effective_right": stronger_border(F.col("border_right"), neighbour("border_left", 1, by_col, "col")),
        "effective_top": stronger_border(F.col("border_top"), neighbour("border_bottom", -1, by_row, "row")),
        "effective_bottom": stronger_border(F.col("border_bottom"), neighbour("border_top", 1, by_row, "row")),
    }
    return cells.withColumns(out)


def place_cells(cells: DataFrame, order: str = "order") -> DataFrame:
    """Topology with overlaps resolved: a cell whose start is taken moves right to the first free column of its row.

    One table is one bounded fold; tables run in parallel. A cell without a
    column (null) takes the first free one, as in row models of markup.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        taken: dict[int, set[int]] = {}
        rows, total = [], 0
        for c in frame.sort_values(["row", order], kind="stable").itertuples():
            used = taken.setdefault(int(c.row), set())
            at = 0 if pd.isna(c.col) else int(c.col)
            while at in used:
                at += 1
            down, right = max(1, min(int(c.row_span), MOST_ROWS - int(c.row))), max(1, min(int(c.col_span), MOST_COLS - at))
            if at >= MOST_COLS or down * right > MOST_CELL_SLOTS or total + down * right > MOST_SLOTS:
                continue
            for r in range(int(c.row), int(c.row) + down):
                line = taken.setdefault(r, set())
                for k in range(at, at + right):
                    if k not in line:
                        line.add(k)
                        total += 1
            rows.append((c.grid, getattr(c, order), int(c.row), at, down, right))
        return pd.DataFrame(rows, columns=["grid", order, "row", "col", "row_span", "col_span"])

    kinds = dict(cells.dtypes)
    return fold_groups(cells, ["grid"], fold, f"grid {kinds['grid']}, {order} {kinds[order]}, row int, col int, row_span int, col_span int")


# -- paragraph ranges


#: Whether text put in at a range's start, and at its end, moves that boundary.
AFFINITIES = {"Default": (False, False), "ShiftAtStart": (True, False), "ExpandAtEnd": (False, True), "ExpandBoth": (False, True), "StrictInterior": (True, False)}


def shift_range(start: Column, count: Column, at: Column, removed: Column, inserted: Column, affinity: str = "Default") -> tuple[Column, Column]:
    """A paragraph range after an edit at ``at``: boundaries behind the edit slide, those inside what went fall to its start.

    A boundary at the edit stays, unless text is only put in and the affinity
    moves it. An empty range slides as a whole.
    """
    moves_start, moves_end = AFFINITIES[affinity]
    grown = inserted - removed

    def boundary(p: Column, moves: bool) -> Column:
        pinned = (p < at) | ((p == at) & ((removed > 0) | F.lit(not moves)))
        return F.when(pinned, p).otherwise(F.when(p >= at + removed, p + grown).otherwise(at))

    first, last = boundary(start, moves_start), boundary(start + count, moves_end)
    slides = (at < start) | ((at == start) & F.lit(moves_start))
    return F.when(count != 0, first).when(slides, start + grown).otherwise(start), F.when(count != 0, F.greatest(last - first, F.lit(0))).otherwise(count)


def relocate_range(start: Column, count: Column, at: Column, moved: Column, target: Column) -> Column:
    """Where a paragraph range begins when the block [at, at + moved) goes in front of ``target``. Ranges that straddle a border of the move stay."""
    last, down = start + count, target > at
    within = lambda low, high: (start >= low) & (last <= high)
    own = within(at, at + moved)
    by = F.when(own, F.when(down, target - moved).otherwise(target) - at)
    by = by.when(down & within(at + moved, target), -moved).when(~down & within(target, at), moved).otherwise(0)
    return start + F.when((moved > 0) & (target != at), by).otherwise(0)


def range_violations(cells: DataFrame) -> DataFrame:
    """Cells whose paragraphs don't follow those of the cell before, in row-major order."""
    line = Window.partitionBy("grid").orderBy("row", "col")
    want = F.lag(F.col("first_paragraph") + F.col("n_paragraphs")).over(line)
    return cells.withColumn("expected", want).where((F.col("expected").isNotNull()) & (F.col("expected") != F.col("first_paragraph")))
