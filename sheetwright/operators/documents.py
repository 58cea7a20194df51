"""Document-level operators: splicing, styles, joined breaks, section pages, workbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwright.operators import text_model

#: The separator for joined breaks, and the longest style name.
PARAGRAPH_SEPARATOR, MOST_STYLE_NAME = "\u2029", 128


def insert_document(target: DataFrame, inserted: DataFrame, at: Column) -> DataFrame:
    """Splices the paragraphs of ``inserted`` (p, text) before paragraph ``at`` of every document of ``target``."""
    n = inserted.count()
    moved = target.select("doc_id", F.when(F.col("p") >= at, F.col("p") + n).otherwise(F.col("p")).alias("p"), "text")
    docs = target.select("doc_id").distinct()
    new = docs.crossJoin(F.broadcast(inserted) if n <= 10_000 else inserted).select("doc_id", (at + F.col("p")).cast("int").alias("p"), "text")
    return moved.unionByName(new)


def import_names(names: DataFrame, taken: DataFrame) -> DataFrame:
    """Adds new_name: names that are taken (without case) get the next free `` (n)``, cut to the longest length."""
    own = names.select("name", F.lower("name").alias("low"))
    held = taken.select(F.lower("name").alias("taken_name")).distinct()
    numbered = taken.select(F.lower(F.regexp_replace("name", r" \(\d+\)$", "")).alias("low"), F.regexp_extract("name", r" \((\d+)\)$", 1).try_cast("int").alias("n"))
    last = numbered.groupBy("low").agg(F.coalesce(F.max("n"), F.lit(1)).alias("n"))
    joined = own.join(held, own["low"] == held["taken_name"], "left").join(last, "low", "left")
    suffix = F.concat(F.lit(" ("), (F.col("n") + 1).cast("string"), F.lit(")"))
    return joined.select("name", F.when(F.col("taken_name").isNull(), F.col("name")).otherwise(F.concat(F.expr(f"substring(name, 1, {MOST_STYLE_NAME})").substr(F.lit(1), F.lit(MOST_STYLE_NAME) - F.length(suffix)), suffix)).alias("new_name"))


def patch_style(style: Column, delta: Column, fields: list[str], clearable: tuple[str, ...] = ()) -> Column:
    """A style under a delta: null keeps a field; of clearable fields, ``set_<field>`` says that null clears."""
    parts = [F.when(F.coalesce(delta[f"set_{f}"], F.lit(False)), delta[f]).otherwise(style[f]) if f in clearable else F.coalesce(delta[f], style[f]) for f in fields]
    return F.struct(*[p.alias(f) for p, f in zip(parts, fields, strict=True)])


def join_deleted_breaks(marks: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, p, text, mark_deleted, boundary) whose break is deleted are joined by a separator, not glued."""
    gone = F.col("mark_deleted") & ~F.col("boundary")
    marked = marks.withColumn("text", F.when(gone, F.concat("text", F.lit(PARAGRAPH_SEPARATOR))).otherwise(F.col("text")))
    return text_model.merge_with_next(marked, gone)


def section_pages(lines: DataFrame) -> DataFrame:
    """Distinct pages that hold a line of each section."""
    return lines.groupBy("doc_id", "section").agg(F.count_distinct("page").alias("n_pages"))


def sections_of(paras: DataFrame, sections: DataFrame) -> DataFrame:
    """The section of each paragraph: the one that began last. Sections don't overlap, so a window finds it without a range join."""
    ends = sections.select("doc_id", F.col("first_paragraph").alias("p"), F.lit(0).alias("side"), F.struct("section", "first_paragraph", "n_paragraphs").alias("s"))
    both = ends.unionByName(paras.select("doc_id", "p", F.lit(1).alias("side"), F.lit(None).cast(ends.schema["s"].dataType).alias("s")))
    w = Window.partitionBy("doc_id").orderBy("p", "side").rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("held")
    found = both.withColumn("held", F.last("s", ignorenulls=True).over(w)).where("side = 1")
    return found.select("doc_id", "p", F.when(F.col("p") < s["first_paragraph"] + s["n_paragraphs"], s["section"]).alias("section"))


def hint_numbers(hints: DataFrame, keys: list[str], order: str, hint: str) -> DataFrame:
    """Running count of page hints."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return hints.withColumn("hint_no", F.sum(F.col(hint).cast("int")).over(w))


def emphasis(kind: Column) -> Column:
    """The inverse of a code: what removing it sets."""
    return F.when(kind.isin("Bold", "Italic", "Underline", "Strike", "Hidden"), F.concat(F.lit("set "), F.lower(kind), F.lit(" false"))).otherwise(F.concat(F.lit("clear "), F.lower(kind)))
