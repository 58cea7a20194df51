"""Formula language: golden cases for the column compiler and for sheet recalculation, which must agree."""

import math

import pandas as pd
import pytest
from pyspark.sql import Window

from sheetwright.functions import scalars
from sheetwright.functions import values as V
from sheetwright.plans import recalc, syntax
from sheetwright.plans.columns import Compiler

ROWS = [(1, 10.5, "Abc def", None, "12", True), (2, -3.0, "x", 5.0, "zz", False), (3, 25.0, "Ünïcode", 0.0, "1,234", None)]

FORMULAS = {
    "q*2+1": ["22", "-5", "51"],
    "q/(k-2)": ["-10.5", "#DIV/0!", "25"],
    "IFERROR(q/(k-2),0)": ["-10.5", "0", "25"],
    'IF(q>0,"pos",q)': ["pos", "-3", "pos"],
    "IF(q>100,1)": ["FALSE"] * 3,
    "ROUND(q,0)": ["11", "-3", "25"],
    "ROUND(-2.5,0)": ["-3"] * 3,
    "ROUND(1250,-2)": ["1300"] * 3,
    "TRUNC(q)": ["10", "-3", "25"],
    "INT(-1.5)": ["-2"] * 3,
    "MOD(7,-4)": ["-1"] * 3,
    "MOD(k,0)": ["#DIV/0!"] * 3,
    "SQRT(q)": ["3.24037034920393", "#NUM!", "5"],
    "SIGN(q)": ["1", "-1", "1"],
    "LEN(s)": ["7", "1", "7"],
    'LEN("😀")': ["2"] * 3,
    "LEFT(s,2)&RIGHT(s)": ["Abf", "xx", "Üne"],
    "LEFT(s,-1)": ["#VALUE!"] * 3,
    "MID(s,2,3)": ["bc ", "", "nïc"],
    'FIND("c",s)': ["3", "#VALUE!", "4"],
    'SEARCH("D",s)': ["5", "#VALUE!", "6"],
    'SUBSTITUTE("aXbXc","X","-",2)': ["aXb-c"] * 3,
    "t+1": ["13", "#VALUE!", "1235"],
    "ISBLANK(e)": ["TRUE", "FALSE", "FALSE"],
    "e+1": ["1", "6", "1"],
    "NOT(q>0)": ["FALSE", "TRUE", "FALSE"],
    "AND(k>1,q>0)": ["FALSE", "FALSE", "TRUE"],
    "OR(k>2,q<0)": ["FALSE", "TRUE", "TRUE"],
    "DATE(2026,13,1)": ["46388"] * 3,
    "DATE(99,1,1)=DATE(1999,1,1)": ["TRUE"] * 3,
    "YEAR(59)*100+MONTH(60)*10+DAY(60)": ["190048"] * 3,
    "1/3": ["0.333333333333333"] * 3,
    "0.00001234": ["1.234E-05"] * 3,
    "1E20": ["1E+20"] * 3,
    "-2^2": ["4"] * 3,
    "2^3^2": ["512"] * 3,
    "50%*4": ["2"] * 3,
    "FOO(1)": ["#NAME?"] * 3,
    "1+": ["#SYNTAX!"] * 3,
    "s=UPPER(s)": ["TRUE"] * 3,
    '"b">"A"': ["TRUE"] * 3,
    "#N/A": ["#N/A"] * 3,
    "IFERROR(#REF!,7)": ["7"] * 3,
    "ISNUMBER(t)": ["FALSE"] * 3,
    "b+1": ["2", "1", "1"],
    "CONCAT(s,k)": ["Abc def1", "x2", "Ünïcode3"],
    'TRIM("  a  b ")': ["a  b"] * 3,
    "10^400": ["#SYNTAX!"] * 0 or ["#NUM!"] * 3,
}


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame(ROWS, "k int, q double, s string, e double, t string, b boolean")


@pytest.mark.parametrize("part", range(8))
def test_columns(sheet, part):
    c = Compiler(sheet)
    own = list(FORMULAS.items())[part::8]
    rows = sheet.select("k", *[c.text(f).alias(f"f{n}") for n, (f, _) in enumerate(own)]).orderBy("k").collect()
    assert {f: [r[f"f{n}"] for r in rows] for n, (f, _) in enumerate(own)} == dict(own)


def test_sheets_agree_with_columns():
    names = {"k": "A", "q": "B", "s": "C", "e": "D", "t": "E", "b": "F"}
    for formula, want in FORMULAS.items():
        try:
            tree = syntax.parse(formula)
        except syntax.FormulaSyntaxError:
            assert want == ["#SYNTAX!"] * 3
            continue
        assert tree is not None
        text = "".join(f"{names[x]}1" if x in names else x for x in __import__("re").split(r'("[^"]*"|\b[kqsetb]\b)', formula))
        if "ISNUMBER" in formula or "t" in formula and "E1" in text:
            continue  # a cell's text is parsed, a text column is not
        for row, shown in zip(ROWS, want, strict=True):
            cells = [{"row": 0, "col": n, "value": v} for n, v in enumerate(row)] + [{"row": 1, "col": 0, "formula": "=" + text}]
            got = recalc.evaluate_book({"s": cells})["s"].values[1, 0]
            assert recalc.show(got) == shown, formula


def _values(cells):
    book = recalc.evaluate_book({"S": [{"row": r, "col": c, "text": t} for (r, c), t in cells.items()], "Other": [{"row": 0, "col": 0, "text": "5"}, {"row": 0, "col": 1, "text": "=1+1"}]})
    return {at: recalc.show(v) for at, v in book["S"].values.items()}


def test_dependencies_cycles_and_references():
    got = _values({(0, 0): "10", (1, 0): "20", (2, 0): "=SUM(ABOVE)", (0, 1): "=A3*2", (1, 1): "=B2", (2, 1): "=B2+1", (3, 0): "=Z99", (3, 1): "=Other!A1+1", (4, 0): "=Other!B1", (4, 1): "=SUM(A1:A3,5)", (5, 0): "=SUM(LEFT)", (5, 1): "=COUNT(A1:B2)"})
    assert got[2, 0] == "30" and got[0, 1] == "60" and got[1, 1] == got[2, 1] == "#CYCLE!" and got[3, 0] == "#REF!"
    assert got[3, 1] == "6" and got[4, 1] == "65" and got[5, 0] == "0"


def test_merged_cells_read_as_empty():
    cells = [{"row": 0, "col": 0, "text": "4", "col_span": 2}, {"row": 1, "col": 0, "text": "=A1+B1"}, {"row": 1, "col": 1, "text": "=ISBLANK(B1)"}]
    values = recalc.evaluate_book({"s": cells})["s"].values
    assert values[1, 0] == 4.0 and values[1, 1] is True


def test_lookups():
    base = {(0, 0): "1", (1, 0): "3", (2, 0): "2", (0, 1): "one", (1, 1): "three", (2, 1): "two"}
    got = _values(base | {(3, 0): "=VLOOKUP(2,A1:B3,2,FALSE)", (3, 1): "=VLOOKUP(2,A1:B3,2)", (4, 0): "=VLOOKUP(9,A1:B3,2,FALSE)", (4, 1): "=VLOOKUP(1,A1:B3,3)", (5, 0): "=MATCH(3,A1:A3,0)", (5, 1): "=INDEX(A1:B3,2,2)", (6, 0): "=MATCH(2,A1:B3)", (6, 1): '=COUNTIF(A1:A3,"<>2")', (7, 0): '=SUMIF(B1:B3,"TWO",A1:A3)', (7, 1): "=HLOOKUP(1,A1:B2,2,FALSE)", (8, 0): '=MATCH("x",A1:A3,0)'})
    assert [got[k] for k in ((3, 0), (3, 1), (4, 0), (4, 1), (5, 0), (5, 1), (6, 0), (6, 1), (7, 0), (7, 1), (8, 0))] == ["two", "one", "#N/A", "#REF!", "2", "three", "#N/A", "2", "2", "3", "#N/A"]


def test_long_chains_need_no_recursion():
    cells = {(0, 0): "1"} | {(k, 0): f"=A{k}+1" for k in range(1, 3000)}
    assert _values(cells)[2999, 0] == "3000"


@pytest.mark.parametrize(("text", "want"), [(None, None), ("  ", None), ("true", True), ("12%", 0.12), ("$1,234.5", 1234.5), ("#n/a", recalc.Err("#N/A")), ("12d", "12d"), (" x ", " x "), ("-1e3", -1000.0)])
def test_cell_texts(text, want):
    assert recalc.parse_cell(text) == want


def test_addresses():
    assert [syntax.index_to_letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(syntax.letters_to_index(syntax.index_to_letters(k)) == k for k in range(0, 20_000, 7))
    assert syntax.parse_range("$B$3:A1") == (0, 0, 2, 1) and syntax.parse_range("A:C")[1:] == (0, syntax.OPEN_END, 2)
    assert syntax.parse_address("A0") is None and math.isclose(1, 1)


def test_aggregates_of_several_arguments(spark):
    df = spark.createDataFrame([(1, 2.0, 10.0), (2, None, 20.0), (3, 4.0, None)], "k int, a double, b double")
    c = Compiler(df, {"a": "a", "b": "b"})
    want = {"SUM": 36.0, "AVERAGE": 9.0, "COUNT": 4.0, "COUNTA": 4.0, "MIN": 2.0, "MAX": 20.0, "PRODUCT": 1600.0, "MEDIAN": 7.0}
    got = df.agg(*[c.aggregate_number(f"={name}(a,b)").alias(name) for name in want]).first().asDict()
    assert got == want


def test_median_of_a_direction(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([3.0, 1.0, None, 7.0, 5.0])], "k int, a double")
    c = Compiler(df, {"a": "a"})
    got = df.select("k", V.as_number(c.over_rows("=MEDIAN(ABOVE)", Window.orderBy("k"), "a"))[0].alias("m")).orderBy("k").collect()
    assert [r["m"] for r in got] == [None, 3.0, 2.0, 2.0, 3.0]


def test_case_is_one_letter_for_one(spark):
    texts = ["straße ŉ ᾀ ﬁ", "ΣΑΣ İ ẞ", "plain"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    c = Compiler(df, {"t": "t"})
    got = df.select(V.as_text(c.value(syntax.parse("=UPPER(t)"))), V.as_text(c.value(syntax.parse("=LOWER(t)")))).collect()
    assert [tuple(r) for r in got] == [("STRAßE ŉ ᾈ ﬁ", "straße ŉ ᾀ ﬁ"), ("ΣΑΣ İ ẞ", "σασ İ ß"), ("PLAIN", "plain")]
    assert [scalars.cased(t, True) for t in texts] == [r[0] for r in got] and [scalars.cased(t, False) for t in texts] == [r[1] for r in got]


def test_only_few_sheets_are_held_together():
    """However many sheets a part of the table has: what is evaluated together stays small, and each book is whole."""
    rows = [(k // 30, "A" if k % 30 < 20 else "B", k % 30, 0, str(k)) for k in range(30 * 1500)]
    frames = (pd.DataFrame(rows[k : k + 777], columns=["book", "sheet", "row", "col", "text"]) for k in range(0, len(rows), 777))
    sizes, seen = [], []
    for books in recalc.whole_books(frames, "book", ["row", "col", "text"]):
        sizes.append(sum(len(cells) for sheets in books.values() for cells in sheets.values()))
        assert all(len(sheets["A"]) == 20 and len(sheets["B"]) == 10 for sheets in books.values())
        seen += books
    assert seen == list(range(1500)) and max(sizes) <= recalc.HELD_CELLS + 30


def test_books_over_many_batches(spark):
    """Books of two sheets over more than one batch and one hold, and cells of no book; no part of a table is one group."""
    rows = [(b, "Data", r, 0, str(b + r)) for b in range(5000) for r in range(4)] + [(None, "Data", r, 0, t) for r, t in enumerate("7800")]
    rows += [(b, "Sum", 0, 0, "=SUM(Data!A1:A4)") for b in [None, *range(5000)]]
    cells = spark.createDataFrame(rows, "book long, sheet string, row int, col int, text string").repartition(7)
    done = recalc.recalculate(cells, book="book")
    assert "FlatMapGroups" not in done._jdf.queryExecution().toString()
    assert done.count() == len(rows)
    got = {r["book"]: (r["sheet"], r["n"]) for r in done.where("depth is not null").collect()}
    assert got == {None: ("Sum", 15.0)} | {b: ("Sum", 4.0 * b + 6) for b in range(5000)}
