"""Rules on cells and edits: filters, validation, conditional formats, edit checks, coercion.

Filters, validation and conditional formats are definitions that sheets carry;
evaluating them is an extension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwright.functions import values as V
from sheetwright.functions.values import Val
from sheetwright.sources import ingest

#: Limits of edits.
MOST_INSERTED, MOST_DOCUMENT, MOST_PARAGRAPHS, MOST_NAME, MOST_LINK = 1 << 20, 16 << 20, 1 << 20, 256, 2048


def passes_filter(value: Column, allowed: list[str], blanks: bool) -> Column:
    """A column filter: one of the listed values (without case), or blank where blanks are kept."""
    blank = value.isNull() | (F.trim(value) == "")
    return F.when(blank, F.lit(blanks)).otherwise(F.upper(value).isin([a.upper() for a in allowed]))


def _compare(x: Column, op: str, a: Column, b: Column | None) -> Column:
    return {
        "Between": lambda: x.between(a, b),
        "NotBetween": lambda: ~x.between(a, b),
        "Equal": lambda: x == a,
        "NotEqual": lambda: x != a,
        "GreaterThan": lambda: x > a,
        "LessThan": lambda: x < a,
        "GreaterThanOrEqual": lambda: x >= a,
        "LessThanOrEqual": lambda: x <= a,
    }[op]()


def is_valid(value: Val, kind: str, op: str = "Between", first=None, second=None, listed: list[str] | None = None, allow_blank: bool = True) -> Column:
    """Whether a cell meets a validation rule: WholeNumber, Decimal, Date, Time, TextLength or List."""
    number, err = V.as_number(value)
    real = F.lit(True) if err is None else err.isNull()
    lit = lambda x: None if x is None else F.lit(float(x))
    if kind == "List":
        test = F.upper(V.as_text(value)).isin([x.upper() for x in listed or []])
    elif kind == "TextLength":
        test = _compare(F.length(V.as_text(value)).cast("double"), op, lit(first), lit(second))
    elif kind == "None":
        test = F.lit(True)
    else:
        test = real & _compare(number, op, lit(first), lit(second))
        if kind == "WholeNumber":
            test = test & (F.floor(number) == number)
    return F.when(V.is_empty(value), F.lit(allow_blank)).otherwise(F.coalesce(test, F.lit(False)))


def matches_rule(value: Val, kind: str, op: str | None = None, first=None, second=None) -> Column:
    """Whether a conditional format applies: CellIs and the text and blank rules."""
    text, wanted = F.upper(V.as_text(value)), str(first or "").upper()
    if kind == "CellIs":
        number, err = V.as_number(value)
        test = _compare(number, op, F.lit(float(first)), None if second is None else F.lit(float(second)))
        return F.coalesce(test if err is None else err.isNull() & test, F.lit(False))
    return {
        "ContainsText": lambda: text.contains(wanted),
        "NotContainsText": lambda: ~text.contains(wanted),
        "BeginsWith": lambda: text.startswith(wanted),
        "EndsWith": lambda: text.endswith(wanted),
        "Blanks": lambda: V.is_empty(value),
        "NoBlanks": lambda: ~V.is_empty(value),
    }[kind]()


def repeated_values(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds duplicate and unique: how a value stands among its range's."""
    n = F.count("*").over(Window.partitionBy(*keys, F.upper(F.col(value).cast("string"))))
    return cells.withColumns({"duplicate": n > 1, "unique": n == 1})


def colour_scale(cells: DataFrame, keys: list[str], value: str, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Adds colour (ARGB): linear between the range's least and largest value."""
    w = Window.partitionBy(*keys)
    least, most = F.min(value).over(w), F.max(value).over(w)
    part = F.when(most > least, (F.col(value) - least) / (most - least)).otherwise(0.0)
    shades = [F.lpad(F.hex(F.floor(a + (b - a) * part + 0.5).cast("int")), 2, "0") for a, b in zip(low, high, strict=True)]
    return cells.withColumn("colour", F.concat(F.lit("FF"), *shades))


def first_format(rules: list[tuple[Column, str]]) -> Column:
    """The format of the first rule, by priority, that applies; later ones are stopped."""
    out = F.lit(None).cast("string")
    for test, name in reversed(rules):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


# -- edits of formatting codes


def replacement_code(text: Column, document_chars: Column, removed_chars: Column, document_paragraphs: Column, removed_breaks: Column) -> Column:
    """The code of what is wrong with a replacement of text; null if nothing is."""
    breaks = F.size(F.regexp_extract_all(text, F.lit("\r\n?|\n"), F.lit(0)))
    out = F.when(text.isNull() | (F.length(text) > MOST_INSERTED), "FCEDIT010").when(text.rlike(r"[\x{D800}-\x{DFFF}]"), "FCEDIT011")
    out = out.when(document_chars - removed_chars + F.length(text) > MOST_DOCUMENT, "FCEDIT012")
    return out.when(document_paragraphs - removed_breaks + breaks > MOST_PARAGRAPHS, "FCEDIT013")


def inline_code(font: Column, size: Column, link: Column, scale: Column, offset: Column, language: Column, style: Column) -> Column:
    """The code of what is wrong with an inline style; nulls are not set."""
    control = lambda c: c.rlike(r"\p{Cc}")
    odd = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    out = F.when((F.length(font) > MOST_NAME) | control(font), "FCEDIT020").when(odd(size) | (size < 1) | (size > 512), "FCEDIT021")
    bad_link = (F.length(link) > MOST_LINK) | control(link) | ~((link == "") | (ingest.link_allowed(link) & ~link.startswith("#")))
    out = out.when(bad_link, "FCEDIT022").when(odd(scale) | (scale <= 0) | (scale > 10) | odd(offset) | (F.abs(offset) > 10), "FCEDIT023")
    out = out.when((F.length(language) < 2) | (F.length(language) > 63) | ~language.rlike(r"^[A-Za-z0-9]{1,8}(-[A-Za-z0-9]{1,8})*$"), "FCEDIT024")
    return out.when((F.trim(style) == "") | (F.length(style) > MOST_NAME) | control(style), "FCEDIT025")


def paragraph_code(alignment: Column, kind: Column, indent: Column, line: Column, before: Column, after: Column) -> Column:
    """The code of what is wrong with a paragraph style; nulls are not set."""
    odd = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    out = F.when(~alignment.isin("Left", "Center", "Right", "Justify"), "FCEDIT034").when(~kind.isin("None", "Bullet", "Numbered"), "FCEDIT035")
    out = out.when((indent < 0) | (indent > 100), "FCEDIT030").when(odd(line) | (line <= 0) | (line > 100), "FCEDIT031")
    return out.when(odd(before) | (before < 0) | (before > 10000), "FCEDIT032").when(odd(after) | (after < 0) | (after > 10000), "FCEDIT033")


# -- coercion of loose text


def to_double(text: Column) -> Column:
    """Numbers, percentages, money and dates (as serials); null if it is none."""
    t = F.trim(text)
    bare = F.regexp_replace(t, r"[$€£¥]", "")
    percent = F.when(t.endswith("%"), V.parse_number(F.regexp_replace(t, "%$", ""), grouped=True) / 100)
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), V.to_serial(t.try_cast("timestamp")))
    return F.coalesce(percent, V.parse_number(bare, grouped=True), day)


def to_boolean(text: Column) -> Column:
    """TRUE, YES, Y and 1; FALSE, NO, N and 0; else null."""
    t = F.upper(F.trim(text))
    return F.when(t.isin("TRUE", "YES", "Y", "1"), True).when(t.isin("FALSE", "NO", "N", "0"), False)


def to_day(text: Column) -> Column:
    """The date of a date text or a serial; null if it is neither."""
    t = F.trim(text)
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_date(t.try_cast("timestamp"))), V.from_serial(V.parse_number(t)))


def capitalise(text: Column, mode: str) -> Column:
    """AllCaps, Lowercase, or a capital at the start of each word."""
    if mode == "AllCaps":
        return F.upper(text)
    if mode == "Lowercase":
        return F.lower(text)
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")
