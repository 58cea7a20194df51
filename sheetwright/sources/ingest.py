"""Ingest: bytes, format selection, limits, metadata, links and time stamps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits, probe confidences.
MOST_PROBE, MOST_DOCUMENT, MOST_DEPTH, MOST_RUN, MOST_PARAGRAPHS, MOST_BINARY = 4096, 64 << 20, 256, 1 << 20, 1 << 20, 16 << 20
CONFIDENCE = {"None": 0, "Low": 25, "Medium": 50, "High": 75, "Certain": 100}


@dataclass(frozen=True)
class Codec:
    """A format: where its probe matches the first bytes (as text), and how sure that makes it."""

    name: str
    extensions: tuple[str, ...]
    media_types: tuple[str, ...]
    probe: str
    confidence: str
    can_read: bool = True


CODECS = (
    Codec("html", ("html", "htm"), ("text/html",), r"(?i)^\s*<!doctype html|^\s*<html", "Certain"),
    Codec("rtf", ("rtf",), ("application/rtf",), r"^\{\\rtf", "Certain", False),
    Codec("pdf", ("pdf",), ("application/pdf",), r"^%PDF-", "Certain", False),
    Codec("json", ("json",), ("application/json",), r"^\s*[\[{]", "Medium"),
    Codec("markdown", ("md",), ("text/markdown",), r"(?m)^(#{1,6} |\* |- )", "Low"),
    Codec("table", ("csv",), ("text/csv",), r"^[^\n|]* \| ", "Low"),
    Codec("text", ("txt",), ("text/plain",), r"(?s)^.", "Low"),
)


def read_bytes(spark: SparkSession, path: str, most: int = MOST_DOCUMENT) -> DataFrame:
    """path, content and the text of the probe; files over the limit keep their row without content."""
    files = spark.read.format("binaryFile").load(path)
    small = F.col("length") <= most
    return files.select("path", "length", F.when(small, F.col("content")).alias("content"), F.decode(F.substring(F.col("content"), 1, MOST_PROBE), "UTF-8").alias("prefix"), F.when(~small, F.lit("document.limit.bytes")).alias("diagnostic"))


def select_codec(inputs: DataFrame, prefix: str, codecs: tuple[Codec, ...] = CODECS) -> DataFrame:
    """Adds codec, confidence and status: the surest probe wins, of several the one registered first."""
    start = F.substring(F.col(prefix), 1, MOST_PROBE)
    scores = F.array(*[F.struct(F.when(start.rlike(c.probe), CONFIDENCE[c.confidence]).otherwise(0).alias("confidence"), F.lit(-k).alias("order"), F.lit(c.name).alias("name"), F.lit(c.can_read).alias("can_read")) for k, c in enumerate(codecs)])
    out = inputs.withColumn("codec_best", F.array_max(scores))
    best = F.col("codec_best")
    none = best["confidence"] == 0
    status = F.when(none, "document.input.unreadable").when(~best["can_read"], "document.capability.not-composed").otherwise("Success")
    return out.withColumns({"codec": F.when(~none, best["name"]), "confidence": best["confidence"], "status": status}).drop("codec_best")


def codec_by_extension(inputs: DataFrame, extension: str, codecs: tuple[Codec, ...] = CODECS) -> DataFrame:
    """Adds the codec registered for an extension, without case."""
    pairs = {e: c.name for c in codecs for e in c.extensions}
    index = F.create_map(*[F.lit(x) for p in pairs.items() for x in p])
    return inputs.withColumn("codec", F.try_element_at(index, F.lower(F.regexp_replace(F.col(extension), r"^\.", ""))))


def status_of(diagnostics: DataFrame, keys: list[str], severity: str = "severity") -> DataFrame:
    """Partial if any diagnostic is above Info, else Success."""
    return diagnostics.groupBy(*keys).agg(F.when(F.bool_or(F.coalesce(F.col(severity) != "Info", F.lit(False))), "Partial").otherwise("Success").alias("status"))


def limit_findings(chars: Column, paragraphs: Column, most_chars: int = MOST_RUN, most_paragraphs: int = MOST_PARAGRAPHS) -> Column:
    """The first limit that a document breaks."""
    return F.when(chars > most_chars, "document.limit.run").when(paragraphs > most_paragraphs, "document.limit.paragraphs")


def metadata_report(stated: Column, unsupported: Column, narrowed: Column) -> tuple[Column, Column, Column]:
    """(kept, lost, narrowed) field names, sorted: what a format can't say is lost, what it says in part is narrowed."""
    return F.array_sort(F.array_except(stated, unsupported)), F.array_sort(F.array_intersect(stated, unsupported)), F.array_sort(F.array_intersect(stated, narrowed))


def link_allowed(link: Column) -> Column:
    """Whether a link may be kept: a fragment without quotes, marks or spaces, or an absolute http, https or mailto address."""
    clean = (link != "") & ~link.rlike(r"[\p{Cc}\x{D800}-\x{DFFF}]")
    fragment = link.rlike(r'^#[^"#\s]+$')
    web = link.rlike(r"(?i)^https?://[^\s/?#]+([/?#]\S*)?$") | link.rlike(r"(?i)^mailto:\S+$")
    return F.coalesce(clean & (fragment | web), F.lit(False))


def parse_timestamp(text: Column) -> Column:
    """A W3C date (year, month, day, minute, second or fraction) as (at, has_zone)."""
    form = r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"
    full = F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01"))).when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text)
    at = F.when(text.rlike(form), full.try_cast("timestamp"))
    return F.when(at.isNotNull(), F.struct(at.alias("at"), text.rlike(r"T.*(Z|[+-]\d{2}:\d{2})$").alias("has_zone")))


def format_timestamp(at: Column, has_zone: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(has_zone, "Z").otherwise(""))


def permitted(requests: DataFrame, resources: DataFrame) -> DataFrame:
    """Adds allowed: the resource is known with this digest and all operations asked for (bit masks) are permitted."""
    known = resources.select("resource_id", F.col("digest").alias("known_digest"), F.col("permitted").alias("known_permitted"))
    joined = requests.join(known, "resource_id", "left")
    allowed = (F.col("digest") == F.col("known_digest")) & (F.col("known_permitted").bitwiseAND(F.col("operations")) == F.col("operations"))
    return joined.withColumn("allowed", F.coalesce(allowed, F.lit(False))).drop("known_digest", "known_permitted")


def workbook_cells(paras: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of a document's tables as sheet cells: stored text, else the cell's paragraphs joined; continuations have none."""
    held = cells.alias("c").join(paras.alias("q"), (F.col("c.doc_id") == F.col("q.doc_id")) & (F.col("q.p") >= F.col("c.first_paragraph")) & (F.col("q.p") < F.col("c.first_paragraph") + F.col("c.n_paragraphs")))
    rows = F.array_sort(F.collect_list(F.struct(F.col("q.p").alias("p"), F.col("q.text").alias("text"))))
    return held.groupBy("c.doc_id", "c.sheet", "c.row", "c.col").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


def document_paragraphs(cells: DataFrame) -> DataFrame:
    """Sheet cells as a document's paragraphs, a paragraph for each line of a cell, numbered in sheet and cell order."""
    lines = cells.select("sheet_no", "row", "col", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("k", "text"))
    from pyspark.sql import Window

    order = Window.partitionBy("sheet_no").orderBy("row", "col", "k")
    numbered = lines.withColumn("in_sheet", F.row_number().over(order) - 1)
    sizes = numbered.groupBy("sheet_no").agg(F.count("*").alias("n"))
    base = sizes.select("sheet_no", (F.sum("n").over(Window.orderBy("sheet_no")) - F.col("n")).alias("base"))  # a row for each sheet
    return numbered.join(base, "sheet_no").select((F.col("base") + F.col("in_sheet")).alias("p"), "sheet_no", "row", "col", "text")
