"""Typed values as Spark columns.

A value is a Python-side ``Val``: the kind that the schema proves, a column of
that kind's Spark type and, where an operator can fail, a column with an error
code (null: no error). Errors are values and travel along; nothing here raises
at run time. A null in a source column is an empty cell: 0, "" or FALSE when it
is coerced. Kind ``any`` holds a struct (t, n, s, b, e) for cells whose kind
differs by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The struct of a cell of unknown kind: t is number, text, boolean, empty or error.
CELL = "struct<t:string,n:double,s:string,b:boolean,e:string>"

DIV0, VALUE, REF, NAME, NUM, NA, CYCLE, SYNTAX = "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#CYCLE!", "#SYNTAX!"


@dataclass(frozen=True)
class Val:
    kind: str  # number, text, boolean, empty, any
    col: Column
    err: Column | None = None
    nullable: bool = False  # null stands for an empty cell


def number(col: Column, err: Column | None = None) -> Val:
    return Val("number", col, err)


def text(col: Column, err: Column | None = None) -> Val:
    return Val("text", col, err)


def boolean(col: Column, err: Column | None = None) -> Val:
    return Val("boolean", col, err)


def error(code: str) -> Val:
    return Val("empty", F.lit(None).cast("double"), F.lit(code))


def empty() -> Val:
    return Val("empty", F.lit(None).cast("double"))


def of_column(name: str, kind: T.DataType) -> Val:
    """A source column as a value; dates and timestamps become serials."""
    col = F.col(name)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Val("number", to_serial(col), None, True)
    if isinstance(kind, T.NumericType):
        return Val("number", col.cast("double"), None, True)
    if isinstance(kind, T.BooleanType):
        return Val("boolean", col, None, True)
    if isinstance(kind, T.StructType) and [f.name for f in kind.fields] == ["t", "n", "s", "b", "e"]:
        return Val("any", col)
    return Val("text", col.cast("string"), None, True)


def first_error(*errs: Column | None) -> Column | None:
    """The first error in argument order."""
    real = [e for e in errs if e is not None]
    return None if not real else real[0] if len(real) == 1 else F.coalesce(*real)


def err_of(v: Val) -> Column | None:
    return F.when(v.col["t"] == "error", v.col["e"]) if v.kind == "any" else v.err


def guard(v: Column, err: Column | None) -> Val:
    """A number; NaN and infinities are #NUM!."""
    bad = F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(NUM))
    return number(F.when(bad.isNull(), v), first_error(err, bad))


_PLAIN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_GROUPED = r"^\s*[+-]?(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_number(s: Column, grouped: bool = False) -> Column:
    """A double, or null. The pattern keeps out the suffixes that a cast would take."""
    cleaned = F.replace(F.trim(s), F.lit(","), F.lit("")) if grouped else F.trim(s)
    return F.when(s.rlike(_GROUPED if grouped else _PLAIN), cleaned.try_cast("double"))


def as_number(v: Val) -> tuple[Column, Column | None]:
    """(double, error): what can't be read as a number is #VALUE!."""
    if v.kind == "number":
        return (F.coalesce(v.col, F.lit(0.0)) if v.nullable else v.col), v.err
    if v.kind == "boolean":
        return F.coalesce(v.col.cast("double"), F.lit(0.0)), v.err
    if v.kind == "empty":
        return F.lit(0.0), v.err
    if v.kind == "text":
        blank = v.col.isNull() if v.nullable else F.lit(False)
        got = F.when(blank, F.lit(0.0)).otherwise(parse_number(v.col, grouped=True))
        return got, first_error(v.err, F.when(got.isNull(), F.lit(VALUE)))
    c = v.col
    got = F.when(c["t"] == "number", c["n"]).when(c["t"] == "boolean", c["b"].cast("double")).when(c["t"] == "empty", F.lit(0.0)).when(c["t"] == "text", parse_number(c["s"], grouped=True))
    return got, first_error(err_of(v), F.when(got.isNull(), F.lit(VALUE)))


def as_boolean(v: Val) -> tuple[Column, Column | None]:
    if v.kind == "boolean":
        return F.coalesce(v.col, F.lit(False)), v.err
    if v.kind == "number":
        return F.coalesce(v.col, F.lit(0.0)) != 0, v.err
    if v.kind == "empty":
        return F.lit(False), v.err
    word = lambda s: F.when(F.upper(s) == "TRUE", True).when(F.upper(s) == "FALSE", False)
    if v.kind == "text":
        got = F.when(v.col.isNull(), F.lit(False)).otherwise(word(v.col)) if v.nullable else word(v.col)
    else:
        c = v.col
        got = F.when(c["t"] == "boolean", c["b"]).when(c["t"] == "number", c["n"] != 0).when(c["t"] == "empty", False).when(c["t"] == "text", word(c["s"]))
    return got, first_error(err_of(v), F.when(got.isNull(), F.lit(VALUE)))


def general(x: Column) -> Column:
    """A number as text: whole below 1e15 without decimals, else 15 significant digits.

    The number is bound once: a long formula would otherwise be repeated for each use.
    """
    return F.get(F.transform(F.array(x), _general), 0)


def _general(x: Column) -> Column:
    size = F.abs(x)
    power = F.when(size == 0, F.lit(0)).otherwise(F.floor(F.log10(size))).cast("int")
    strip = lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    plain = strip(F.replace(F.call_function("format_number", x, F.greatest(F.lit(0), F.lit(14) - power)), F.lit(","), F.lit("")))
    mantissa = strip(F.call_function("format_number", x / F.pow(F.lit(10.0), power), F.lit(14)))
    scientific = F.concat(mantissa, F.lit("E"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    whole = (F.floor(x) == x) & (size < 1e15)
    return F.when(whole, x.cast("bigint").cast("string")).when((power >= 15) | (power < -4), scientific).otherwise(plain)


def as_text(v: Val) -> Column:
    """The formatted value; errors are kept apart, see ``err_of``."""
    if v.kind == "number":
        return F.coalesce(general(v.col), F.lit("")) if v.nullable else general(v.col)
    if v.kind == "boolean":
        return F.coalesce(F.when(v.col, "TRUE").otherwise("FALSE"), F.lit("")) if not v.nullable else F.when(v.col.isNull(), "").when(v.col, "TRUE").otherwise("FALSE")
    if v.kind == "empty":
        return F.lit("")
    if v.kind == "text":
        return F.coalesce(v.col, F.lit("")) if v.nullable else v.col
    c = v.col
    return F.when(c["t"] == "number", general(c["n"])).when(c["t"] == "boolean", F.when(c["b"], "TRUE").otherwise("FALSE")).when(c["t"] == "text", c["s"]).when(c["t"] == "error", c["e"]).otherwise("")


def is_empty(v: Val) -> Column:
    if v.kind == "empty":
        return F.lit(v.err is None)
    if v.kind == "any":
        return v.col["t"] == "empty"
    none = v.col.isNull() if v.nullable else F.lit(False)
    return none if v.err is None else none & v.err.isNull()


def compare(left: Val, right: Val) -> Column:
    """-1, 0 or 1: as booleans, as numbers where one side is a number and the other can be one, else as upper-cased text."""
    order = lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)
    as_words = order(F.upper(as_text(left)), F.upper(as_text(right)))
    if left.kind == right.kind == "boolean":
        return order(as_boolean(left)[0].cast("int"), as_boolean(right)[0].cast("int"))
    if "any" not in (left.kind, right.kind):
        if "number" not in (left.kind, right.kind):
            return as_words
        a, b = as_number(left)[0], as_number(right)[0]
        return F.when(a.isNull() | b.isNull(), as_words).otherwise(order(a, b))
    kind = lambda v: v.col["t"] if v.kind == "any" else F.lit(v.kind)
    a, b = as_number(left)[0], as_number(right)[0]
    numeric = ((kind(left) == "number") | (kind(right) == "number")) & a.isNotNull() & b.isNotNull()
    both = (kind(left) == "boolean") & (kind(right) == "boolean")
    return F.when(numeric | both, order(a, b)).otherwise(as_words)


def fuzzy_equal(left: Val, right: Val) -> Column:
    """Numbers within 1e-9; else text without case."""
    if "any" not in (left.kind, right.kind) and "number" not in (left.kind, right.kind):
        return F.upper(as_text(left)) == F.upper(as_text(right))
    a, b = as_number(left)[0], as_number(right)[0]
    kind = lambda v: v.col["t"] if v.kind == "any" else F.lit(v.kind)
    numeric = ((kind(left) == "number") | (kind(right) == "number")) & a.isNotNull() & b.isNotNull()
    return F.when(is_empty(left) & is_empty(right), True).when(numeric, F.abs(a - b) < 1e-9).otherwise(F.upper(as_text(left)) == F.upper(as_text(right)))


def criteria(v: Val, wanted: str | float | bool) -> Column:
    """Whether a cell meets a criterion; never null.

    A relational operator with a number only meets numbers, ``<>`` with a number
    also what is none; a relational operator with text meets nothing.
    """
    is_number = v.col.isNotNull() if v.kind == "number" else (v.col["t"] == "number") if v.kind == "any" else F.lit(False)
    n = v.col if v.kind == "number" else v.col["n"] if v.kind == "any" else F.lit(None).cast("double")
    if v.err is not None:
        is_number = is_number & v.err.isNull()
    if isinstance(wanted, bool):
        wanted = "TRUE" if wanted else "FALSE"
    if not isinstance(wanted, str):
        return F.coalesce(is_number & (F.abs(n - float(wanted)) < 1e-9), F.lit(False))
    wanted = wanted.strip()
    op = next((o for o in (">=", "<=", "<>", ">", "<", "=") if wanted.startswith(o)), "")
    rest = wanted[len(op) :]
    value = _plain_number(rest)
    same = F.upper(as_text(v)) == rest.upper()
    if op in (">=", "<=", ">", "<"):
        if value is None:
            return F.lit(False)
        test = {">=": n >= value, "<=": n <= value, ">": n > value, "<": n < value}[op]
        return F.coalesce(is_number & test, F.lit(False))
    if op == "<>":
        return ~same if value is None else F.coalesce(~is_number | (n != value), F.lit(True))
    return same if value is None else F.coalesce(is_number & (F.abs(n - value) < 1e-9), F.lit(False))


def _plain_number(s: str) -> float | None:
    import re

    return float(s) if re.match(_PLAIN, s) else None


def to_serial(day: Column) -> Column:
    """Days since 1899-12-30, one less before 1900-03-01, with the part of the day."""
    days = F.datediff(F.to_date(day), F.lit("1899-12-30").cast("date")).cast("double")
    part = (F.unix_micros(day.cast("timestamp")) - F.unix_micros(F.date_trunc("day", day.cast("timestamp")))) / F.lit(86_400_000_000.0)
    serial = days + part
    return F.when(F.to_date(day) < F.lit("1900-03-01").cast("date"), serial - 1).otherwise(serial)


def from_serial(serial: Column) -> Column:
    """The date of a serial; 59 and 60 are both 1900-02-28."""
    whole = F.floor(serial).cast("int")
    return F.date_add(F.when(serial < 60, F.lit("1899-12-31").cast("date")).otherwise(F.lit("1899-12-30").cast("date")), whole)


def parse_cell(s: Column) -> Column:
    """Text to a cell struct: blank, error, boolean, percentage, currency, number with thousands, else the text as given."""
    t = F.trim(s)
    upper = F.upper(t)
    codes = [DIV0, VALUE, REF, NAME, NUM, NA, CYCLE, SYNTAX]
    percent = F.when(t.rlike(r"%$"), parse_number(F.regexp_replace(t, r"%$", ""), grouped=True) / 100)
    money = F.when(t.startswith("$"), parse_number(F.substring(t, 2, 1 << 30), grouped=True))
    plain = parse_number(t, grouped=True)
    got = F.coalesce(percent, money, plain)
    code = F.when(upper.isin(codes), upper).when(upper == "#N/A!", F.lit(NA))
    cell = lambda t, **k: F.struct(F.lit(t).alias("t"), *[(k[c] if c in k else F.lit(None)).cast(d).alias(c) for c, d in (("n", "double"), ("s", "string"), ("b", "boolean"), ("e", "string"))])
    out = F.when(s.isNull() | (t == ""), cell("empty")).when(code.isNotNull(), cell("error", e=code))
    out = out.when(upper.isin("TRUE", "FALSE"), cell("boolean", b=upper == "TRUE")).when(got.isNotNull(), cell("number", n=got))
    return out.otherwise(cell("text", s=s))


def cell_struct(v: Val) -> Column:
    """Any value as a cell struct."""
    if v.kind == "any":
        return v.col
    none = {c: F.lit(None).cast(d) for c, d in (("n", "double"), ("s", "string"), ("b", "boolean"))}
    field = {"number": "n", "text": "s", "boolean": "b"}.get(v.kind)
    ok = v.err.isNull() if v.err is not None else F.lit(True)
    there = F.lit(False) if field is None else v.col.isNotNull()
    kind = F.when(~ok, "error").when(there, v.kind).otherwise("empty")
    parts = [(F.when(ok, v.col) if c == field else none[c]).alias(c) for c in ("n", "s", "b")]
    return F.struct(kind.alias("t"), *parts, (v.err if v.err is not None else F.lit(None).cast("string")).alias("e"))
