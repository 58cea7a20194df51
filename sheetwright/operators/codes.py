"""Formatting codes: a readable projection of styled text, with offsets both ways.

Paragraphs are projected independently; only the offsets need the lengths of
the paragraphs before, a running sum for each document. Tokens are rows
(doc_id, p, seq, kind, text, mode, source start and end), in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inline codes by rank: name of the style field, code, whether it carries a value.
INLINE_CODES = (
    ("bold", "Bold", False),
    ("italic", "Italic", False),
    ("underline", "Underline", False),
    ("strike", "Strike", False),
    ("font_family", "Font", True),
    ("font_size", "Size", True),
    ("foreground", "Color", True),
    ("background", "Highlight", True),
    ("link", "Link", True),
    ("hidden", "Hidden", False),
    ("caps", "Caps", True),
    ("language", "Language", True),
    ("baseline", "Baseline", True),
    ("character_style", "Style", True),
)

#: Paragraph codes: field, code, default.
PARAGRAPH_CODES = (("alignment", "Align", "Left"), ("list_kind", "List", "None"), ("indent_level", "Indent", 0), ("line_spacing", "Line Spacing", 1.0), ("spacing_before", "Space Before", 0.0), ("spacing_after", "Space After", 0.0), ("page_break_before", "Page Break", False))

#: Most characters of a quoted value; limits of a projection.
MOST_QUOTED, MOST_CHARS, MOST_TOKENS = 8_192, 16 * 1024 * 1024, 2_000_000

#: Format characters of 16 bits; pairs of surrogates are text.
_FORMAT = r"\x{AD}\x{600}-\x{605}\x{61C}\x{6DD}\x{70F}\x{890}\x{891}\x{8E2}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}"
_SPECIAL = rf"[\t\x{{2028}}\x{{FFFC}}\\\[\]\p{{Cc}}\p{{Zl}}\p{{Zp}}{_FORMAT}]"
_PARTS = rf"{_SPECIAL}|[^{_SPECIAL[1:-1]}]+"
_TOKEN = "array<struct<kind:string,text:string,size:int,mode:string>>"


def content_tokens(text: Column, note: Column | None = None) -> Column:
    """The tokens of a stretch of text: literal runs, structure codes and escapes."""
    mark = F.lit("[Image]") if note is None else F.when(note, "[Note]").otherwise("[Image]")

    def token(x: Column) -> Column:
        hexed = F.concat(F.lit("\\u{"), F.lpad(F.hex(F.ascii(x)), 4, "0"), F.lit("}"))
        escape = F.when(x.isin("\\", "[", "]"), F.concat(F.lit("\\"), x)).otherwise(hexed)
        structure = F.when(x == "\t", "[Tab]").when(x == "\u2028", "[Line Break]").when(x == "\ufffc", mark)
        plain = ~x.rlike(f"^{_SPECIAL}$")
        kind = F.when(plain, "Text").when(structure.isNotNull(), "StructureCode").otherwise("Escape")
        shown = F.when(plain, x).otherwise(F.coalesce(structure, escape))
        return F.struct(kind.alias("kind"), shown.alias("text"), F.length(x).alias("size"), F.when(plain, "Linear").otherwise("Expanded").alias("mode"))

    return F.transform(F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0)), token)


def escaped(text: Column) -> Column:
    """Content as it reads in the projection."""
    return F.array_join(F.transform(content_tokens(text), lambda t: t["text"]), "")


def quoted(value: Column) -> Column:
    """A value between quotes: backslashes and quotes escaped, cut at the limit."""
    cut = F.substring(value, 1, MOST_QUOTED)
    return F.concat(F.lit('"'), F.replace(F.replace(cut, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _code(text: Column, kind: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(0).alias("size"), F.lit("Boundary").alias("mode"))


def transition(before: Column, after: Column, fields: set[str]) -> Column:
    """Codes between two styles: what changed and was on closes in reverse order, then what changed and is on opens."""
    closes, opens = [], []
    for name, code, valued in INLINE_CODES:
        if name not in fields:
            continue
        a, b = before[name], after[name]
        changed = ~a.eqNullSafe(b)
        on = (lambda c: c.isNotNull()) if valued else (lambda c: F.coalesce(c, F.lit(False)))
        closes.append(F.when(changed & on(a), _code(F.lit(f"[/{code}]"), "InlineCode")))
        opening = F.concat(F.lit(f"[{code} "), quoted(b.cast("string")), F.lit("]")) if valued else F.lit(f"[{code}]")
        opens.append(F.when(changed & on(b), _code(opening, "InlineCode")))
    return F.array_compact(F.array(*closes[::-1], *opens)) if closes else F.expr(f"cast(array() as {_TOKEN})")


def paragraph_codes(style: Column, fields: set[str]) -> Column:
    """Codes of a paragraph's style where it is not the default."""
    out = []
    for name, code, default in PARAGRAPH_CODES:
        if name not in fields:
            continue
        v = style[name]
        shown = F.lit(f"[{code}]") if isinstance(default, bool) else F.concat(F.lit(f"[{code} "), F.upper(v.cast("string")) if isinstance(default, str) else v.cast("string"), F.lit("]"))
        out.append(F.when(F.coalesce(v != default, F.lit(False)), _code(shown, "ParagraphCode")))
    return F.array_compact(F.array(*out)) if out else F.expr(f"cast(array() as {_TOKEN})")


def project(runs: DataFrame, paras: DataFrame) -> DataFrame:
    """Tokens of whole documents.

    runs: doc_id, p, run_no, text, style (struct). paras: doc_id, p, style (struct), one row for each paragraph.
    """
    inline = set(runs.schema["style"].dataType.fieldNames())
    block = set(paras.schema["style"].dataType.fieldNames())
    w = Window.partitionBy("doc_id", "p").orderBy("run_no")
    none = F.lit(None).cast(runs.schema["style"].dataType)
    parts = runs.select("doc_id", "p", "run_no", F.concat(transition(F.lag("style").over(w), F.col("style"), inline), content_tokens(F.col("text"))).alias("tokens"))
    ends = runs.groupBy("doc_id", "p").agg(F.max_by("style", "run_no").alias("style"), F.sum(F.length("text")).alias("n")).select("doc_id", "p", transition(F.col("style"), none, inline).alias("close"), "n")
    body = F.array_sort(F.collect_list(F.struct("run_no", "tokens")))
    bodies = parts.groupBy("doc_id", "p").agg(F.flatten(F.transform(body, lambda x: x["tokens"])).alias("body"))
    last = F.max("p").over(Window.partitionBy("doc_id")) == F.col("p")
    nothing = F.expr(f"cast(array() as {_TOKEN})")
    mark = F.struct(F.lit("StructureCode").alias("kind"), F.lit("[Paragraph Break]\n").alias("text"), F.lit(1).alias("size"), F.lit("Expanded").alias("mode"))
    blank = F.struct(F.lit("StructureCode").alias("kind"), F.lit("[Empty Paragraph]").alias("text"), F.lit(0).alias("size"), F.lit("Boundary").alias("mode"))
    whole = paras.select("doc_id", "p", paragraph_codes(F.col("style"), block).alias("head"), last.alias("last")).join(bodies, ["doc_id", "p"], "left").join(ends, ["doc_id", "p"], "left")
    listed = F.concat("head", F.coalesce("body", nothing), F.coalesce("close", nothing), F.when(F.coalesce("n", F.lit(0)) == 0, F.array(blank)).otherwise(nothing), F.when(F.col("last"), nothing).otherwise(F.array(mark)))
    tokens = whole.select("doc_id", "p", F.posexplode(listed).alias("k", "token")).select("doc_id", "p", "k", "token.*")
    return with_spans(tokens)


def with_spans(tokens: DataFrame) -> DataFrame:
    """Adds seq, the projected span and the source span of every token."""
    doc = Window.partitionBy("doc_id").orderBy("p", "k")
    para = Window.partitionBy("doc_id", "p").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    source = F.coalesce(F.sum(F.when(F.col("text") == "[Paragraph Break]\n", 0).otherwise(F.col("size"))).over(para), F.lit(0))
    start = F.sum(F.length("text")).over(doc) - F.length("text")
    return tokens.select("doc_id", "p", (F.row_number().over(doc) - 1).alias("seq"), "kind", "text", "mode", start.alias("start"), F.length("text").alias("length"), source.alias("source_start"), "size")


def projected_text(tokens: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return tokens.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("projected"))


def to_source(probes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Document position (p, offset) of projected offsets: linear within text; elsewhere the nearer end of the token.

    The token that holds an offset is the last one that begins at or before it, which a window over both finds.
    """
    left = tokens.where("length > 0").select("doc_id", F.col("start").alias("at"), F.lit(0).alias("side"), F.struct("p", "start", "length", "mode", "source_start", "size").alias("token"), F.lit(None).cast("long").alias("probe"))
    right = probes.select("doc_id", F.col("offset").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(left.schema["token"].dataType).alias("token"), F.col("offset").cast("long").alias("probe"))
    before = Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    held = left.unionByName(right).withColumn("t", F.last("token", ignorenulls=True).over(before)).where("side = 1 and t is not null")
    t, into = F.col("t"), F.col("probe") - F.col("t")["start"]
    inside = F.when(t["mode"] == "Linear", F.least(into, t["size"].cast("long"))).when(into * 2 >= t["length"], t["size"].cast("long")).otherwise(F.lit(0).cast("long"))
    return held.select("doc_id", F.col("probe").alias("offset"), t["p"].alias("p"), (t["source_start"] + inside).alias("source_offset"))


def to_projected(positions: DataFrame, tokens: DataFrame, last: bool = False) -> DataFrame:
    """Projected offset of document positions; the first (or last) place that shows the position."""
    at = tokens.select("doc_id", "p", "start", "length", "mode", "source_start", "size")
    joined = positions.join(at, ["doc_id", "p"])
    before, after = F.col("offset") == F.col("source_start"), F.col("offset") == F.col("source_start") + F.col("size")
    linear = (F.col("mode") == "Linear") & F.col("offset").between(F.col("source_start"), F.col("source_start") + F.col("size"))
    spot = F.when(linear, F.col("start") + F.col("offset") - F.col("source_start")).when(before, F.col("start")).when(after, F.col("start") + F.col("length"))
    return joined.withColumn("spot", spot).where("spot is not null").groupBy("doc_id", "p", "offset").agg((F.max if last else F.min)("spot").alias("projected_offset"))


def diagnostics(tokens: DataFrame) -> DataFrame:
    """Documents whose projection is over the limits."""
    size = tokens.groupBy("doc_id").agg(F.sum("length").alias("n_chars"), F.count("*").alias("n_tokens"))
    return size.where((F.col("n_chars") > MOST_CHARS) | (F.col("n_tokens") > MOST_TOKENS))
