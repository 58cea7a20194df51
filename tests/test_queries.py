"""Every query with SQL gives the rows of that SQL."""

import importlib.util
import math

import duckdb
import pytest

import __spark_entry__
from sheetwright.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    got = sorted(repr([_plain(v) for v in r]) for r in df.select(*columns).collect())
    assert got == sorted(repr([_plain(r[names.index(c)]) for c in columns]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


#: text; word breaks, mandatory breaks and clusters; projected paragraphs
ODD_DOCUMENTS = [
    (None, (0, 0, 0), [""]),
    ("", (0, 0, 0), [""]),
    ("a\r\nb\rc d", (1, 2, 7), ["a", "b", "c d"]),
    ("日本。語（x", (2, 0, 6), ["日本。語（x"]),
    ("e\u0301 x\u00a0y\u2060", (1, 0, 6), ["e\u0301 x\u00a0y\\u{2060}"]),
    ("“curly” – dash", (2, 0, 14), ["“curly” – dash"]),
    ("👍🏽 👨\u200d👩\u200d👧", (1, 0, 3), ["👍🏽 👨\\u{200D}👩\\u{200D}👧"]),
    ("\u00adz\u2028q\u2029\u3000\u2007", (2, 2, 7), ["\\u{00AD}z[Line Break]q\\u{2029}\u3000\u2007"]),
    ("a\U000e0001b\U00020000\x01\ufffc[", (1, 0, 7), ["a\U000e0001b\U00020000\\u{0001}[Image]\\["]),
]


def test_documents_of_any_characters(spark, tmp_path):
    rows = [(k, text) for k, (text, _, _) in enumerate(ODD_DOCUMENTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["word_breaks"], r["mandatory"], r["clusters"]) for r in QUERIES["boundary_classes"](spark, str(tmp_path)).collect()}
    assert got == {k: counts for k, (_, counts, _) in enumerate(ODD_DOCUMENTS)}
    lines: dict = {}
    for r in QUERIES["format_codes_paragraphs"](spark, str(tmp_path)).orderBy("doc_id", "p").collect():
        lines.setdefault(r["doc_id"], []).append(r["projected"])
    assert lines == {k: projected for k, (_, _, projected) in enumerate(ODD_DOCUMENTS)}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    both = all(importlib.util.find_spec(name) for name in ("corpus_pipeline", "sheetwright.llm"))
    assert ("pipeline" in __spark_entry__.queries()) == both
