"""Packing of lines and columns onto pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwright.functions import numbering
from sheetwright.operators.folds import fold_groups

#: Tolerance of a page's room, a sheet column's width and its tolerance.
ROOM, COLUMN_WIDTH, COLUMN_TOLERANCE = 0.001, 72.0, 0.01


def lines_that_fit(heights: Column, start: Column, room: Column, orphans: Column, widows: Column) -> Column:
    """How many lines from ``start`` (from 0) fit, leaving no fewer than ``widows`` and none if fewer than ``orphans``."""
    rest = F.slice(heights, start + 1, F.greatest(F.size(heights) - start, F.lit(0)))
    zero = F.struct(F.lit(0.0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def take(acc: Column, h: Column) -> Column:
        full = acc["full"] | (acc["used"] + h > room + ROOM)
        return F.struct(F.when(full, acc["used"]).otherwise(acc["used"] + h).alias("used"), F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"), full.alias("full"))

    fit, left = F.aggregate(rest, zero, take)["n"], F.size(rest)
    kept = F.when(left - fit < F.greatest(widows, F.lit(0)), F.greatest(F.lit(0), left - F.greatest(widows, F.lit(0)))).otherwise(fit)
    return F.when(fit == left, fit).when((start == 0) & (kept < F.greatest(orphans, F.lit(0))), 0).otherwise(kept)


def pack_greedily(sizes: list[float], room: float, tolerance: float) -> list[int]:
    """The part of each size, in order; a part takes at least one."""
    out, used, part = [], 0.0, 0
    for s in sizes:
        if used and used + s > room + tolerance:
            part, used = part + 1, 0.0
        out.append(part)
        used += s
    return out


def column_runs(columns: DataFrame, room: float) -> DataFrame:
    """Cuts a sheet's columns (sheet, col, width, used) into page-wide runs; of several runs, those without content go."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("col", kind="stable")
        frame["run"] = pack_greedily(frame["width"].fillna(COLUMN_WIDTH).tolist(), room, COLUMN_TOLERANCE)
        out = frame.groupby("run").agg(first=("col", "min"), last=("col", "max"), used=("used", "any")).reset_index()
        if len(out) > 1:
            out = out[out["used"]]
        out["run"] = range(len(out))
        out.insert(0, "sheet", frame["sheet"].iloc[0])
        return out[["sheet", "run", "first", "last"]].astype({"run": "int32", "first": "int32", "last": "int32"})

    return fold_groups(columns, ["sheet"], fold, f"sheet {dict(columns.dtypes)['sheet']}, run int, first int, last int")


def overflow_columns(cells: DataFrame, n_cols: int) -> DataFrame:
    """How far the text of a filled cell may run over empty neighbours to its right: up to the next filled cell."""
    w = Window.partitionBy("sheet", "row").orderBy("col")
    following = F.lead("col").over(w)
    return cells.where("filled").withColumn("free_until", F.coalesce(following, F.lit(n_cols)) - 1)


def balance(sizes: list[float], n: int, tolerance: float = 0.01) -> tuple[float, list[int]]:
    """The least height at which ``sizes`` pack into ``n`` columns, by bisection; the column of each."""
    low, high = max(sizes, default=0.0), sum(sizes)
    while high - low > tolerance:
        middle = (low + high) / 2
        parts = pack_greedily(sizes, middle, 0.0)
        low, high = (low, middle) if not parts or parts[-1] < n else (middle, high)
    return high, pack_greedily(sizes, high, 0.0)


def balance_columns(lines: DataFrame, n: int) -> DataFrame:
    """Balances the lines (section, line, height) of each section over ``n`` columns."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line", kind="stable")
        height, parts = balance(frame["height"].tolist(), n)
        return pd.DataFrame({"section": frame["section"], "line": frame["line"], "column": parts, "height": height}).astype({"column": "int32"})

    kinds = dict(lines.dtypes)
    return fold_groups(lines, ["section"], fold, f"section {kinds['section']}, line {kinds['line']}, column int, height double")


def keep_chains(blocks: DataFrame, keys: list[str], order: str, keep: str) -> DataFrame:
    """Adds chain: blocks kept with the next one belong together."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = ~F.coalesce(F.lag(keep).over(w), F.lit(False))
    return blocks.withColumn("chain_new", new.cast("int")).withColumn("chain", F.sum("chain_new").over(w) - 1).drop("chain_new")


def paginate(blocks: DataFrame, room: float) -> DataFrame:
    """Pages of the blocks (doc_id, position, height, break_before, keep_with_next) of each document.

    A chain moves to the next page if its blocks up to the first free to break don't fit, unless it is taller than a page.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position", kind="stable")
        heights, breaks, keeps = frame["height"].tolist(), frame["break_before"].tolist(), frame["keep_with_next"].tolist()
        pages, tops, page, used, k = [], [], 0, 0.0, 0
        while k < len(heights):
            end = k
            while end < len(heights) - 1 and keeps[end]:
                end += 1
            whole = sum(heights[k : end + 1])
            if used and (breaks[k] or (used + whole > room + ROOM and whole <= room + ROOM)):
                page, used = page + 1, 0.0
            for j in range(k, end + 1):
                if used and used + heights[j] > room + ROOM:
                    page, used = page + 1, 0.0
                pages.append(page)
                tops.append(used)
                used += heights[j]
            k = end + 1
        return pd.DataFrame({"doc_id": frame["doc_id"], "position": frame["position"], "page": pages, "top": tops}).astype({"page": "int32"})

    kinds = dict(blocks.dtypes)
    return fold_groups(blocks, ["doc_id"], fold, f"doc_id {kinds['doc_id']}, position {kinds['position']}, page int, top double")


def wrap_words(widths: list[float], gap: float, room: float, tolerance: float = 0.01) -> list[int]:
    """Greedy lines: the line of each word; a word that is too wide stands alone."""
    out, used, line = [], None, 0
    for w in widths:
        if used is not None and used + gap + w > room + tolerance:
            line, used = line + 1, None
        used = w if used is None else used + gap + w
        out.append(line)
    return out


def compose_paragraphs(paras: DataFrame, room: float, advance: float = 1.0) -> DataFrame:
    """Lines of paragraphs (doc_id, p, text) under a fixed advance for each character."""

    def run(batches):
        for frame in batches:
            rows = []
            for c in frame.itertuples():
                own = (c.text or "").split(" ")
                lines = wrap_words([len(w) * advance for w in own], advance, room)
                for k in sorted(set(lines)):
                    rows.append((c.doc_id, c.p, k, " ".join(w for w, at in zip(own, lines, strict=True) if at == k)))
            yield pd.DataFrame(rows, columns=["doc_id", "p", "line", "text"]).astype({"line": "int32"})

    kinds = dict(paras.dtypes)
    return paras.select("doc_id", "p", "text").mapInPandas(run, f"doc_id {kinds['doc_id']}, p {kinds['p']}, line int, text string")


def page_field(page: Column, adjust: Column, name: str = "Decimal") -> Column:
    """A page number field's text; below 1 it is empty."""
    n = page + adjust
    return F.when(n < 1, "").otherwise(numbering.column(n, name))


def grid_rows(height: Column, pitch: Column) -> Column:
    """Rows of a text grid that a line takes."""
    return F.greatest(F.lit(1), F.ceil(height / pitch - 0.001).cast("int"))


def column_extents(cells: DataFrame, room: float) -> DataFrame:
    """Automatic column widths: what all columns need at least, and the rest by what they would like to have."""
    own = cells.groupBy("grid", "col").agg(F.max("least").alias("least"), F.max("wanted").alias("wanted"))
    table = Window.partitionBy("grid")
    need, like = F.sum("least").over(table), F.sum("wanted").over(table)
    more = F.when(like > need, (F.col("wanted") - F.col("least")) / (like - need)).otherwise(0.0)
    width = F.when(like <= room, F.col("wanted")).when(need >= room, F.col("least")).otherwise(F.col("least") + more * (room - need))
    return own.select("grid", "col", width.alias("width"))


#: Strong characters by direction.
_RTL, _LTR = r"[\p{IsHebrew}\p{IsArabic}\p{IsSyriac}\p{IsThaana}\p{IsNko}]", r"\p{L}"


def text_direction(text: Column) -> Column:
    """1 if the first strong letter is right-to-left, 2 if left-to-right, 3 with digits alone, else 0."""
    strong = F.regexp_extract(text, _LTR, 0)
    return F.when(strong.rlike(_RTL), 1).when(strong != "", 2).when(text.rlike(r"\p{Nd}"), 3).otherwise(0)
