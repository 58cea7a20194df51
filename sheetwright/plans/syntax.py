"""Formula text to a syntax tree.

Grammar, loosest first: comparisons, ``&``, ``+ -``, ``* /``, ``^`` (to the
right), signs, postfix ``%``. A sign binds tighter than ``^``: ``-2^2`` is 4.
A formula that can't be read gives ``FormulaSyntaxError``; callers turn it into
the value ``#SYNTAX!``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Error texts.
ERRORS = ("#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#CYCLE!", "#SYNTAX!")

#: Directional ranges.
DIRECTIONS = ("ABOVE", "BELOW", "LEFT", "RIGHT")

#: Stands for the open end of a whole-row or whole-column range.
OPEN_END = 2**31 - 1


class FormulaSyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Literal:
    value: float | str | bool | None


@dataclass(frozen=True)
class ErrorLiteral:
    code: str


@dataclass(frozen=True)
class Ref:
    row: int
    col: int
    sheet: str | None = None


@dataclass(frozen=True)
class Range:
    row0: int
    col0: int
    row1: int
    col1: int
    sheet: str | None = None


@dataclass(frozen=True)
class Direction:
    kind: str


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Unary:
    op: str
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


_TOKEN = re.compile(
    r"""\s*(?:
      (?P<text>"(?:[^"]|"")*")
    | (?P<sheet>'(?:[^']|'')*')
    | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    | (?P<error>\#[A-Za-z/0-9]+[!?]?)
    | (?P<name>[$A-Za-z_][$A-Za-z_0-9.]*)
    | (?P<op><>|!=|<=|>=|[-+*/^%&(),:=<>!])
    )""",
    re.VERBOSE,
)
_CELL = re.compile(r"\$?([A-Za-z]{1,3})\$?([0-9]+)$")
_COLUMN = re.compile(r"\$?([A-Za-z]{1,3})$")
_ROW = re.compile(r"\$?([0-9]+)$")
_LEVELS = (("=", "<>", "!=", "<=", ">=", "<", ">"), ("&",), ("+", "-"), ("*", "/"), ("^",))


def letters_to_index(letters: str) -> int:
    """A is 0, Z 25, AA 26."""
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def index_to_letters(index: int) -> str:
    out, n = "", index + 1
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_address(text: str) -> tuple[int, int] | None:
    """(row, column) from 0, ``$`` ignored."""
    m = _CELL.match(text.strip())
    return (int(m[2]) - 1, letters_to_index(m[1])) if m and int(m[2]) > 0 else None


def parse_range(text: str) -> tuple[int, int, int, int] | None:
    """(row0, col0, row1, col1) with ends in order; whole rows and columns have open ends."""
    first, colon, second = text.strip().partition(":")
    if not colon:
        at = parse_address(first)
        return (*at, *at) if at else None
    a, b = parse_address(first), parse_address(second)
    if a and b:
        return min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])
    a, b = _COLUMN.match(first), _COLUMN.match(second)
    if a and b:
        x, y = sorted((letters_to_index(a[1]), letters_to_index(b[1])))
        return 0, x, OPEN_END, y
    a, b = _ROW.match(first), _ROW.match(second)
    if a and b:
        x, y = sorted((int(a[1]) - 1, int(b[1]) - 1))
        return (x, 0, y, OPEN_END) if x >= 0 else None
    return None


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaSyntaxError(f"unexpected {text[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens = tokenize(text)
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "")

    def take(self, op: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if op is not None and token != ("op", op):
            raise FormulaSyntaxError(f"expected {op!r}, found {token[1]!r}")
        self.at += 1
        return token

    def level(self, k: int):
        if k == len(_LEVELS):
            return self.sign()
        left = self.level(k + 1)
        while self.peek()[0] == "op" and self.peek()[1] in _LEVELS[k]:
            op = self.take()[1]
            right = self.level(k) if op == "^" else self.level(k + 1)
            left = Binary("<>" if op == "!=" else op, left, right)
        return left

    def sign(self):
        if self.peek() in (("op", "+"), ("op", "-")):
            op = self.take()[1]
            return Unary(op, self.sign())
        inner = self.primary()
        while self.peek() == ("op", "%"):
            self.take()
            inner = Unary("%", inner)
        return inner

    def primary(self):
        kind, text = self.take()
        if kind == "number":
            if self.peek() == ("op", ":") and self.peek(1)[0] == "number":
                self.take()
                return self._range(text, self.take()[1], None)
            return Literal(float(text))
        if kind == "text":
            return Literal(text[1:-1].replace('""', '"'))
        if kind == "error":
            code = text.upper()
            if code in ("#N/A!",):
                code = "#N/A"
            if code not in ERRORS:
                raise FormulaSyntaxError(f"unknown error {text!r}")
            return ErrorLiteral(code)
        if kind == "op" and text == "(":
            inner = self.level(0)
            self.take(")")
            return inner
        if kind == "sheet" or (kind == "name" and self.peek() == ("op", "!")):
            sheet = text[1:-1].replace("''", "'") if kind == "sheet" else text
            self.take("!")
            return self._reference(self.take()[1], sheet)
        if kind == "name":
            if self.peek() == ("op", "("):
                self.take()
                args = []
                if self.peek() != ("op", ")"):
                    args.append(self.level(0))
                    while self.peek() == ("op", ","):
                        self.take()
                        args.append(self.level(0))
                self.take(")")
                return Call(text.upper(), tuple(args))
            return self._reference(text, None)
        raise FormulaSyntaxError(f"unexpected {text!r}")

    def _reference(self, text: str, sheet: str | None):
        if self.peek() == ("op", ":"):
            self.take()
            return self._range(text, self.take()[1], sheet)
        if at := parse_address(text):
            return Ref(*at, sheet)
        upper = text.upper()
        if sheet is None and upper in DIRECTIONS:
            return Direction(upper)
        if sheet is None and upper in ("TRUE", "FALSE"):
            return Literal(upper == "TRUE")
        if sheet is not None:
            raise FormulaSyntaxError(f"no cell {text!r}")
        return Name(text)

    def _range(self, first: str, second: str, sheet: str | None):
        got = parse_range(f"{first}:{second}")
        if not got:
            raise FormulaSyntaxError(f"no range {first}:{second}")
        return Range(*got, sheet)


def parse(formula: str):
    """The tree of ``formula``, with or without a leading ``=``."""
    text = formula.strip()
    parser = _Parser(text[1:] if text.startswith("=") else text)
    tree = parser.level(0)
    if parser.peek()[0] != "end":
        raise FormulaSyntaxError(f"unexpected {parser.peek()[1]!r}")
    return tree


def references(tree) -> list:
    """All Ref, Range and Direction nodes of a tree."""
    if isinstance(tree, (Ref, Range, Direction)):
        return [tree]
    if isinstance(tree, Unary):
        return references(tree.of)
    if isinstance(tree, Binary):
        return references(tree.left) + references(tree.right)
    if isinstance(tree, Call):
        return [r for a in tree.args for r in references(a)]
    return []
