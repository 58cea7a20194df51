"""Operators of the text model: paragraphs, style runs, positions, boundaries, revisions.

Paragraphs are rows (doc_id, p, text); runs are rows (doc_id, p, run_no, length,
style). Offsets count UTF-16 units where noted, as documents are edited in
them; text in the basic plane is the same in both counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each paragraph; a text has at least one."""
    lines = F.split(normalise_newlines(F.coalesce(F.col(text), F.lit(""))), "\n", -1)
    return docs.select(F.col(doc).alias("doc_id"), F.posexplode(lines).alias("p", "text"))


def plain_text(paras: DataFrame) -> DataFrame:
    """Paragraphs joined by line feeds."""
    rows = F.array_sort(F.collect_list(F.struct("p", "text")))
    return paras.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


def slice_text(paras: DataFrame, first: tuple[Column, Column], last: tuple[Column, Column]) -> DataFrame:
    """The range between two positions (paragraph, offset); both end paragraphs are cut. Positions are clamped."""
    (p0, o0), (p1, o1) = first, last
    size = F.length("text")
    begin = F.when(F.col("p") == p0, F.least(F.greatest(o0, F.lit(0)), size)).otherwise(F.lit(0))
    end = F.when(F.col("p") == p1, F.least(F.greatest(o1, F.lit(0)), size)).otherwise(size)
    cut = F.substring(F.col("text"), begin + 1, F.greatest(end - begin, F.lit(0)))
    return paras.where((F.col("p") >= p0) & (F.col("p") <= p1)).select("doc_id", (F.col("p") - p0).alias("p"), cut.alias("text"))


def insert_text(paras: DataFrame, p: Column, offset: Column, inserted: Column) -> DataFrame:
    """Insert text at a position; line breaks in it split the paragraph."""
    at = F.least(F.greatest(offset, F.lit(0)), F.length("text"))
    whole = F.concat(F.substring(F.col("text"), F.lit(1), at), normalise_newlines(inserted), F.substring(F.col("text"), at + 1, F.length("text")))
    lines = F.when(F.col("p") == p, F.split(whole, "\n", -1)).otherwise(F.array("text"))
    added = F.size(F.split(normalise_newlines(inserted), "\n", -1)) - 1
    base = F.when(F.col("p") > p, F.col("p") + added).otherwise(F.col("p"))
    return paras.select("doc_id", base.alias("base"), F.posexplode(lines).alias("k", "text")).select("doc_id", (F.col("base") + F.col("k")).alias("p"), "text")


def delete_range(paras: DataFrame, first: tuple[Column, Column], last: tuple[Column, Column]) -> DataFrame:
    """Remove the range between two positions; what is left of its ends becomes one paragraph."""
    (p0, o0), (p1, o1) = first, last
    head = F.when(F.col("p") == p0, F.substring(F.col("text"), F.lit(1), o0)).otherwise("")
    tail = F.when(F.col("p") == p1, F.substring(F.col("text"), o1 + 1, F.length("text"))).otherwise("")
    inside = (F.col("p") >= p0) & (F.col("p") <= p1)
    part = F.when(inside, F.concat(head, tail)).otherwise(F.col("text"))
    to = F.when(inside, p0).when(F.col("p") > p1, F.col("p") - p1 + p0).otherwise(F.col("p"))
    rows = paras.select("doc_id", to.alias("to"), "p", part.alias("text"))
    joined = F.array_sort(F.collect_list(F.struct("p", "text")))
    return rows.groupBy("doc_id", F.col("to").alias("p")).agg(F.array_join(F.transform(joined, lambda x: x["text"]), "").alias("text"))


def merge_with_next(paras: DataFrame, joined_to_next: Column) -> DataFrame:
    """Paragraphs whose mark is gone run on into the next one; the first of a chain gives its number."""
    w = Window.partitionBy("doc_id").orderBy("p")
    starts = ~F.coalesce(F.lag(joined_to_next).over(w), F.lit(False))
    chained = paras.withColumn("chain_start", starts.cast("int")).withColumn("chain", F.sum("chain_start").over(w))
    rows = F.array_sort(F.collect_list(F.struct("p", "text")))
    merged = chained.groupBy("doc_id", "chain").agg(F.min("p").alias("p"), F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("text"))
    return merged.select("doc_id", (F.col("chain") - 1).cast("int").alias("p"), F.col("p").alias("first_p"), "text")


# -- runs


def run_offsets(runs: DataFrame, keys: list[str], order: str, length: str = "length") -> DataFrame:
    """Adds where each run starts: the lengths of the runs before it."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)))


def coalesce_runs(runs: DataFrame, keys: list[str], order: str, style: str, length: str = "length") -> DataFrame:
    """Neighbours with equal styles become one run; empty runs go."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = ~F.col(style).eqNullSafe(F.lag(style).over(w)) | F.lag(order).over(w).isNull()
    islands = runs.where(F.col(length) > 0).withColumn("run_new", new.cast("int")).withColumn("island", F.sum("run_new").over(w))
    out = islands.groupBy(*keys, "island").agg(F.first(style).alias(style), F.sum(length).alias(length), F.min(order).alias(f"first_{order}"))
    return out.withColumn("run_no", F.col("island") - 1).drop("island")


def style_at(positions: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """The run that holds each position; ``runs`` has start and length. An equi-join on the paragraph bounds the range test."""
    held = runs.select(*keys, F.struct("start", "length", "style").alias("held_run"))
    r = F.col("held_run")
    met = positions.join(held, keys).where((F.col("offset") >= r["start"]) & (F.col("offset") < r["start"] + r["length"]))
    found = met.select(*keys, "offset", "held_run").distinct()
    return positions.join(found, [*keys, "offset"], "left").select(*positions.columns, r["style"].alias("style"), r["start"].alias("start"))


def apply_style(runs: DataFrame, keys: list[str], begin: Column, end: Column, patched: Column) -> DataFrame:
    """Patch the style of the range [begin, end): runs are cut at its borders, patched inside and joined again."""
    start, stop = F.col("start"), F.col("start") + F.col("length")
    piece = lambda a, b, s: F.when(b > a, F.struct(a.cast("long").alias("start"), (b - a).cast("long").alias("length"), s.alias("style")))
    left, right = F.least(F.greatest(start, begin), stop), F.greatest(F.least(stop, end), start)
    inner = F.greatest(left, right)
    pieces = F.array_compact(F.array(piece(start, left, F.col("style")), piece(left, inner, patched), piece(inner, stop, F.col("style"))))
    cut = runs.select(*keys, F.explode(pieces).alias("x")).select(*keys, "x.*")
    return coalesce_runs(cut, keys, "start", "style")


# -- boundaries

# Character classes, as patterns.
MANDATORY_BREAK = r"[\n\r\x{2028}\x{2029}]"
BREAKING_SPACE = r"[ \t\x{3000}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{200B}\x{00AD}]"
KEEPING_SPACE = r"[\x{00A0}\x{202F}\x{2007}\x{2060}\x{FEFF}]"
CJK = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}]"
NOT_BEFORE = r"[)\]}»”’,.!?;:、。）】』」〉》]"
NOT_AFTER = r"[(\[{«“‘（【『「〈《]"


def graphemes(text: Column) -> Column:
    """Extended grapheme clusters."""
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def boundary_classes(text: Column) -> Column:
    """What follows each cluster: Mandatory, WordBreak, None (a space that keeps words together) or Grapheme.

    Each cluster is looked at with its follower; the clusters are found once for a text.
    """
    pairs = F.get(F.transform(F.array(graphemes(text)), lambda g: F.arrays_zip(g.alias("x"), F.slice(F.concat(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), F.array(F.lit(""))), F.lit(1), F.size(g)).alias("after"))), 0)

    def judge(pair: Column) -> Column:
        x, after = pair["x"], pair["after"]
        plain = x.between("!", "~")  # most text needs no pattern
        wide = x.rlike(f"^{CJK}") & ~after.rlike(f"^{NOT_BEFORE}")
        return F.when(plain, "Grapheme").when(x.rlike(f"^{MANDATORY_BREAK}"), "Mandatory").when(x.rlike(f"^{BREAKING_SPACE}"), "WordBreak").when(x.rlike(f"^{KEEPING_SPACE}"), "None").when(wide, "WordBreak").otherwise("Grapheme")

    return F.transform(pairs, judge)


# -- revisions


def author_colours(revisions: DataFrame, author: str = "author", position: str = "position", colours: int = 9) -> DataFrame:
    """A colour index for each author, by first appearance."""
    first = revisions.groupBy(author).agg(F.min(position).alias("first_position"))
    return first.select(author, F.pmod(F.row_number().over(Window.orderBy("first_position", author)) - 1, F.lit(colours)).cast("int").alias("colour"))


def accept_deletions(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Text without deleted runs; a deleted paragraph mark joins the next paragraph.

    runs: doc_id, p, run_no, text, deleted. marks: doc_id, p, mark_deleted, boundary (a table or cell ends there).
    """
    left = runs.where(~F.col("deleted"))
    rows = F.array_sort(F.collect_list(F.struct("run_no", "text")))
    text = left.groupBy("doc_id", "p").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("text"))
    paras = marks.join(text, ["doc_id", "p"], "left").select("doc_id", "p", F.coalesce("text", F.lit("")).alias("text"), "mark_deleted", "boundary")
    return merge_with_next(paras, F.col("mark_deleted") & ~F.col("boundary"))


def decorate(kind: Column, moved: Column) -> Column:
    """How a tracked change is drawn."""
    return F.when(kind == "Insertion", F.when(moved, "double underline").otherwise("underline")).when(kind == "Deletion", F.when(moved, "double strike").otherwise("strike")).when(kind == "Format", "bold").otherwise("none")


# -- notes, lines, references


def note_labels(notes: DataFrame, keys: list[str], order: str, custom: str, start: int = 1) -> DataFrame:
    """Running number of each note among its keys; notes with their own mark keep it and use no number."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    number = F.count(F.when(F.col(custom).isNull(), 1)).over(w) + (start - 1)
    return notes.withColumn("number", F.when(F.col(custom).isNull(), number)).withColumn("label", F.coalesce(F.col(custom), F.col("number").cast("string")))


def line_numbers(lines: DataFrame, restart: list[str], order: str, counted: Column, start: int = 1, every: int = 1) -> DataFrame:
    """Line numbers within ``restart``; only every n-th is shown, and lines that don't count have none."""
    w = Window.partitionBy(*restart).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(counted.cast("int")).over(w) + (start - 1)
    return lines.withColumn("line_number", F.when(counted, number)).withColumn("shown", counted & (F.pmod(number, F.lit(every)) == 0))


def carry_forward(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Running content: a row's own value, else the last one before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(f"resolved_{value}", F.last(value, ignorenulls=True).over(w))


def resolve_references(pages: DataFrame, stretches: DataFrame, keys: list[str]) -> DataFrame:
    """The stretch that a page's style reference shows: the first on the page, else the last before it, else the first after it.

    stretches: keys, page, position, text. One window over both, so that no pair of a page and a far stretch is made.
    """
    on = stretches.groupBy(*keys, "page").agg(F.min_by("text", "position").alias("first_text"), F.max_by("text", "position").alias("last_text"))
    seen = pages.select(*keys, "page").join(on, [*keys, "page"], "full_outer")
    before = Window.partitionBy(*keys).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("page").rowsBetween(1, Window.unboundedFollowing)
    shown = F.coalesce("first_text", F.last("last_text", ignorenulls=True).over(before), F.first("first_text", ignorenulls=True).over(after))
    return seen.withColumn("shown", shown).join(pages.select(*keys, "page"), [*keys, "page"], "left_semi").select(*keys, "page", "shown")
