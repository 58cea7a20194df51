"""Scalar operators and functions of the formula language, as Spark columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetwright.functions import values as V
from sheetwright.functions.values import Val

_MANY = 255


def unary(op: str, v: Val) -> Val:
    n, err = V.as_number(v)
    return V.number(n / 100 if op == "%" else -n if op == "-" else n, err)


def binary(op: str, left: Val, right: Val) -> Val:
    errs = V.first_error(V.err_of(left), V.err_of(right))
    if op == "&":
        return V.text(F.concat(V.as_text(left), V.as_text(right)), errs)
    if op in ("=", "<>", "<", "<=", ">", ">="):
        c = V.compare(left, right)
        test = {"=": c == 0, "<>": c != 0, "<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op]
        return V.boolean(test, errs)
    (a, bad_a), (b, bad_b) = V.as_number(left), V.as_number(right)
    errs = V.first_error(errs, bad_a, bad_b)
    if op == "/":
        return V.guard(F.try_divide(a, b), V.first_error(errs, F.when(b == 0, F.lit(V.DIV0))))
    if op == "^":
        return V.guard(F.pow(a, b), errs)
    return V.guard(a + b if op == "+" else a - b if op == "-" else a * b, errs)


def _on_number(build):
    def run(*args: Val) -> Val:
        pairs = [V.as_number(a) for a in args]
        return build(*[p[0] for p in pairs], err=V.first_error(*[p[1] for p in pairs]))

    return run


def round_away(x: Column, digits: Column) -> Column:
    """Half away from zero; negative digits round whole places."""
    d = F.least(F.greatest(digits.cast("int"), F.lit(-15)), F.lit(15))
    factor = F.pow(F.lit(10.0), F.abs(d))
    up = lambda y: F.signum(y) * F.floor(F.abs(y) + 0.5)
    return F.when(d >= 0, F.when(F.abs(x) < 1e15, up(x * factor) / factor).otherwise(x)).otherwise(up(x / factor) * factor)


def _round(x, d=None, err=None):
    return V.guard(round_away(x, F.lit(0) if d is None else d), err)


def _trunc(x, d=None, err=None):
    if d is None:
        return V.guard(F.signum(x) * F.floor(F.abs(x)), err)
    factor = F.pow(F.lit(10.0), d.cast("int"))
    y = x * factor
    return V.guard(F.signum(y) * F.floor(F.abs(y)) / factor, err)


def _mod(n, d, err=None):
    safe = F.when(d != 0, d)
    return V.guard(n - safe * F.floor(n / safe), V.first_error(err, F.when(d == 0, F.lit(V.DIV0))))


def _sqrt(x, err=None):
    return V.number(F.when(x >= 0, F.sqrt(x)), V.first_error(err, F.when(x < 0, F.lit(V.NUM))))


def choose(test: Val, yes: Val, no: Val | None = None) -> Val:
    """IF: only the branch taken counts, its errors too."""
    no = V.boolean(F.lit(False)) if no is None else no
    cond, bad = V.as_boolean(test)
    pick = lambda a, b: F.when(cond, a).otherwise(b)
    none = F.lit(None).cast("string")
    side = pick(V.err_of(yes) if V.err_of(yes) is not None else none, V.err_of(no) if V.err_of(no) is not None else none)
    errs = V.first_error(bad, side if V.err_of(yes) is not None or V.err_of(no) is not None else None)
    kinds = {yes.kind, no.kind} - {"empty"}
    if len(kinds) == 1 and "any" not in kinds:
        (kind,) = kinds
        as_kind = lambda v: v.col if v.kind == kind else F.lit(None).cast({"number": "double", "text": "string", "boolean": "boolean"}[kind])
        return Val(kind, pick(as_kind(yes), as_kind(no)), errs, yes.nullable or no.nullable or "empty" in (yes.kind, no.kind))
    cell = pick(V.cell_struct(yes), V.cell_struct(no))
    if errs is None:
        return Val("any", cell)
    broken = V.cell_struct(Val("empty", F.lit(None).cast("double"), errs))
    return Val("any", F.when(errs.isNotNull(), broken).otherwise(cell))


def if_error(v: Val, other: Val) -> Val:
    err = V.err_of(v)
    if err is None:
        return v
    clean = Val(v.kind, v.col, None, v.nullable)
    return choose(V.boolean(err.isNull()), clean, other)


def _is(kind: str):
    def run(v: Val) -> Val:
        err = V.err_of(v)
        if kind == "error":
            return V.boolean(F.lit(False) if err is None else err.isNotNull())
        if kind == "empty":
            return V.boolean(V.is_empty(v))
        if v.kind == "any":
            return V.boolean(v.col["t"] == kind)
        there = v.col.isNotNull() if v.nullable else F.lit(True)
        test = F.lit(v.kind == kind) & there
        return V.boolean(test if err is None else test & err.isNull())

    return run


def _negate(v: Val) -> Val:
    b, err = V.as_boolean(v)
    return V.boolean(~b, err)


def _every(all_of: bool):
    """AND and OR over single values: decided by the first that settles it or fails."""

    def run(*args: Val) -> Val:
        got, bad = F.lit(all_of), F.lit(None).cast("string")
        for v in reversed(args):
            b, err = V.as_boolean(v)
            settled = ~b if all_of else b
            failed = F.lit(False) if err is None else err.isNotNull()
            bad = F.when(failed, err if err is not None else F.lit(None).cast("string")).when(settled, F.lit(None).cast("string")).otherwise(bad)
            got = F.when(F.coalesce(settled, F.lit(False)), F.lit(not all_of)).otherwise(got)
        return V.boolean(got if args else F.lit(False), bad)

    return run


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("double")


def cased(text: str, upper: bool) -> str:
    """``text`` in capitals or small letters, one letter for one: a letter whose other case is several letters stays, or takes its title form."""
    if len(text) == len(text.upper() if upper else text.lower()) and "Σ" not in text:
        return text.upper() if upper else text.lower()
    return "".join(_cased_letter(c, upper) for c in text)


def _cased_letter(c: str, upper: bool) -> str:
    other, title = (c.upper(), c.title()) if upper else (c.lower(), c)
    return other if len(other) == 1 else title if len(title) == 1 else c


@functools.lru_cache(maxsize=2)
def _odd_letters(upper: bool) -> str:
    """Letters that change their number with their case, and the sigma, which looks at its neighbours."""
    every = (chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return "".join(c for c in every if len(c.upper() if upper else c.lower()) > 1 or (not upper and c == "Σ"))


def _cased_column(upper: bool):
    def run(s: Column) -> Column:
        odd = _odd_letters(upper)
        plain = F.upper if upper else F.lower
        pieces = F.split(s, f"(?<=[{odd}])|(?=[{odd}])")
        apart = F.transform(pieces, lambda p: F.when(p.rlike(f"^[{odd}]$"), F.translate(p, odd, "".join(_cased_letter(c, upper) for c in odd))).otherwise(plain(p)))
        return F.when(s.rlike(f"[{odd}]"), F.array_join(apart, "")).otherwise(plain(s))

    return run


def _trim(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"^[\s\p{Z}\x{85}]+", ""), r"[\s\p{Z}\x{85}]+$", "")


def _side(right: bool):
    def run(v: Val, count: Val | None = None) -> Val:
        n, err = V.as_number(count) if count is not None else (F.lit(1.0), None)
        k = n.cast("int")
        err = V.first_error(V.err_of(v), err, F.when(k < 0, F.lit(V.VALUE)))
        s = V.as_text(v)
        return V.text(F.when(k <= 0, F.lit("")).otherwise(F.right(s, k) if right else F.left(s, k)), err)

    return run


def _mid(v: Val, start: Val, count: Val) -> Val:
    (a, bad_a), (n, bad_n) = V.as_number(start), V.as_number(count)
    err = V.first_error(V.err_of(v), bad_a, bad_n, F.when((a.cast("int") < 1) | (n.cast("int") < 0), F.lit(V.VALUE)))
    return V.text(F.substring(V.as_text(v), F.greatest(a.cast("int"), F.lit(1)), F.greatest(n.cast("int"), F.lit(0))), err)


def _find(upper: bool):
    def run(needle: Val, hay: Val, start: Val | None = None) -> Val:
        n, bad = V.as_number(start) if start is not None else (F.lit(1.0), None)
        a, b = V.as_text(needle), V.as_text(hay)
        if upper:
            a, b = F.upper(a), F.upper(b)
        from_ = n.cast("int")
        at = F.when(a == "", from_).otherwise(F.call_function("locate", a, b, from_))
        err = V.first_error(V.err_of(needle), V.err_of(hay), bad, F.when((from_ < 1) | (from_ > F.length(b) + 1) | (at == 0), F.lit(V.VALUE)))
        return V.number(at.cast("double"), err)

    return run


def _substitute(v: Val, old: Val, new: Val, which: Val | None = None) -> Val:
    s, a, b = V.as_text(v), V.as_text(old), V.as_text(new)
    errs = V.first_error(V.err_of(v), V.err_of(old), V.err_of(new))
    if which is None:
        return V.text(F.when(a == "", s).otherwise(F.replace(s, a, b)), errs)
    n, bad = V.as_number(which)
    k = n.cast("int")
    head = F.call_function("substring_index", s, a, k)
    there = F.length(head) < F.length(s)
    one = F.concat(head, b, F.substring(s, F.length(head) + F.length(a) + 1, F.length(s)))
    return V.text(F.when((a == "") | ~there, s).otherwise(one), V.first_error(errs, bad, F.when(k < 1, F.lit(V.VALUE))))


def _date(year: Val, month: Val, day: Val) -> Val:
    (y, e1), (m, e2), (d, e3) = V.as_number(year), V.as_number(month), V.as_number(day)
    y, m, d = y.cast("int"), m.cast("int"), d.cast("int")
    wrong = F.when((y < 0) | (y > 9999), F.lit(V.NUM))
    full = F.when(y < 1900, y + 1900).otherwise(y)
    first = F.make_date(F.greatest(F.least(full, F.lit(9999)), F.lit(1)), F.lit(1), F.lit(1))
    when = F.date_add(F.add_months(first, m - 1), d - 1)
    return V.number(V.to_serial(when), V.first_error(e1, e2, e3, wrong, F.when((F.year(when) < 1) | (F.year(when) > 9999), F.lit(V.NUM))))


def _part(build):
    def run(v: Val) -> Val:
        n, err = V.as_number(v)
        if v.kind == "text":
            day = F.to_date(V.as_text(v).try_cast("timestamp"))
            got = F.coalesce(F.when(err.isNull(), V.from_serial(n)), day)
            return V.number(build(got).cast("double"), V.first_error(v.err, F.when(got.isNull(), F.lit(V.VALUE))))
        return V.number(build(V.from_serial(n)).cast("double"), err)

    return run


def _concat(*args: Val) -> Val:
    return V.text(F.concat(*[V.as_text(a) for a in args]) if args else F.lit(""), V.first_error(*[V.err_of(a) for a in args]))


def _fold(build):
    """Aggregates whose arguments are single values of one row."""

    def run(*args: Val) -> Val:
        pairs = [V.as_number(a) for a in args]
        return build([p[0] for p in pairs], V.first_error(*[p[1] for p in pairs]))

    return run


def _sum(xs, err):
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return V.guard(out, err)


def _product(xs, err):
    out = xs[0]
    for x in xs[1:]:
        out = out * x
    return V.guard(out, err)


_text1 = lambda build: lambda v: V.text(build(V.as_text(v)), V.err_of(v))

#: Name to (fewest arguments, most arguments, builder).
FUNCTIONS = {
    "IF": (2, 3, choose),
    "IFERROR": (2, 2, if_error),
    "NOT": (1, 1, _negate),
    "AND": (1, _MANY, _every(True)),
    "OR": (1, _MANY, _every(False)),
    "TRUE": (0, 0, lambda: V.boolean(F.lit(True))),
    "FALSE": (0, 0, lambda: V.boolean(F.lit(False))),
    "ISNUMBER": (1, 1, _is("number")),
    "ISTEXT": (1, 1, _is("text")),
    "ISBLANK": (1, 1, _is("empty")),
    "ISERROR": (1, 1, _is("error")),
    "ABS": (1, 1, _on_number(lambda x, err: V.number(F.abs(x), err))),
    "ROUND": (1, 2, _on_number(_round)),
    "INT": (1, 2, _on_number(lambda x, d=None, err=None: V.guard(F.floor(x).cast("double"), err))),
    "TRUNC": (1, 2, _on_number(_trunc)),
    "MOD": (2, 2, _on_number(_mod)),
    "SQRT": (1, 1, _on_number(_sqrt)),
    "POWER": (2, 2, _on_number(lambda a, b, err: V.guard(F.pow(a, b), err))),
    "SIGN": (1, 1, _on_number(lambda x, err: V.number(F.signum(x), err))),
    "LEN": (1, 1, lambda v: V.number(utf16_length(V.as_text(v)), V.err_of(v))),
    "UPPER": (1, 1, _text1(_cased_column(True))),
    "LOWER": (1, 1, _text1(_cased_column(False))),
    "TRIM": (1, 1, _text1(_trim)),
    "LEFT": (1, 2, _side(False)),
    "RIGHT": (1, 2, _side(True)),
    "MID": (3, 3, _mid),
    "FIND": (2, 3, _find(False)),
    "SEARCH": (2, 3, _find(True)),
    "SUBSTITUTE": (3, 4, _substitute),
    "CONCAT": (0, _MANY, _concat),
    "CONCATENATE": (0, _MANY, _concat),
    "TODAY": (0, 0, lambda: V.number(V.to_serial(F.current_date()))),
    "NOW": (0, 0, lambda: V.number(V.to_serial(F.current_timestamp()))),
    "DATE": (3, 3, _date),
    "YEAR": (1, 1, _part(F.year)),
    "MONTH": (1, 1, _part(F.month)),
    "DAY": (1, 1, _part(F.dayofmonth)),
    "SUM": (1, _MANY, _fold(_sum)),
    "PRODUCT": (1, _MANY, _fold(_product)),
    "MIN": (1, _MANY, _fold(lambda xs, err: V.number(F.least(*xs) if len(xs) > 1 else xs[0], err))),
    "MAX": (1, _MANY, _fold(lambda xs, err: V.number(F.greatest(*xs) if len(xs) > 1 else xs[0], err))),
    "AVERAGE": (1, _MANY, _fold(lambda xs, err: V.number(_sum(xs, None).col / len(xs), err))),
    "AVG": (1, _MANY, _fold(lambda xs, err: V.number(_sum(xs, None).col / len(xs), err))),
    "COUNT": (1, _MANY, lambda *vs: V.number(sum((_is("number")(v).col.cast("double") for v in vs), F.lit(0.0)))),
    "COUNTA": (1, _MANY, lambda *vs: V.number(sum(((~V.is_empty(v)).cast("double") for v in vs), F.lit(0.0)))),
}
