"""Vectors, urls, chats and the pipeline."""

import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheetwright.llm import ann, chat_format, components, packing, secret_scan, url_filter
from sheetwright.llm.queries import ORACLES, QUERIES
from sheetwright.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _same(df, con, sql):
    columns = sorted(df.columns)
    want = con.execute(sql)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    return sorted(map(repr, ([*r] for r in df.select(*columns).collect()))) == sorted(repr([r[k] for k in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, duck, name):
    assert _same(QUERIES[name](spark, SF), duck, ORACLES[name])


# -- 7: vectors


def _nearest(x, ids, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return [(int(ids[j]), float(d[j])) for j in order]


def test_nearest_vectors_reach_the_recall(spark):
    random = np.random.default_rng(1)
    centres = random.normal(size=(20, 32))
    x = (centres[random.integers(0, 20, 6000)] + random.normal(size=(6000, 32)) * 0.4).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    found = {}
    for r in ann.search(frame, frame.where("vec_id % 100 = 0"), sample=2000, query_block=25).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits, ids = 0, np.arange(6000)
    for q in range(0, 6000, 100):
        want, got = dict(_nearest(x.astype(np.float64), ids, q)), [found[q][k + 1] for k in range(10)]
        assert got == sorted(got, key=lambda p: (p[1], p[0]))
        hits += len(set(want) & {v for v, _ in got})
        assert all(s == pytest.approx(float(np.sqrt(((x[v].astype(float) - x[q].astype(float)) ** 2).sum())), abs=1e-12) for v, s in got)
    assert hits >= 0.9 * 600


def test_vectors_of_the_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = {}
    for r in QUERIES["op7_nearest_vectors"](spark, SF).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = [len({v for v, _ in _nearest(x, ids, q)} & set(got[q])) for q in ids[ids % 100 == 0]]
    assert np.mean(hits) >= 9


def test_vectors_edge_cases(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [float("inf"), 1.0, 0.0]), (6, [1.0, 2.0]), (None, [1.0, 0.0, 0.0])]
    rows += [(k, [1.0, 0.5, 0.0]) for k in range(50, 90)] + [(100, [1.0, 0.5, 0.0]), (200, [2.0, 0.0, 0.0]), (200, [2.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, v string")
    got = {}
    for r in ann.search(frame, frame.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 100, 200}
    assert [v for _, v, _ in sorted(got[100])] == list(range(50, 60)) and all(s == 0 for _, _, s in got[100])
    assert [v for _, v, _ in sorted(got[0])] == list(range(50, 60))
    assert [v for _, v, _ in sorted(got[200])][0] == 0 or sorted(got[200])[0][2] == 1.0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(few, few.where("vec_id = 0")).collect()] == [(0, 1)]
    assert ann.search(few.limit(0), few.limit(0)).count() == 0


def test_copies_of_a_vector_over_many_slices_of_a_task(spark):
    """A hot vector in a third of 99,000 rows of one task, with the smallest ids last, and neighbours just beyond it."""
    random = np.random.default_rng(5)
    x = random.normal(size=(99_000, 8))
    hot = np.arange(0, 99_000, 3)
    x[hot] = 4.0
    x[90_001:90_061:3] = 4.0 + random.normal(size=(20, 8)) * 0.01
    ids = np.arange(99_000)[::-1]
    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(ids), "embedding": pa.array(list(x), pa.list_(pa.float64()))})).coalesce(1)
    own, near = int(ids[hot[500]]), int(ids[90_001])
    queries = frame.where(F.col("vec_id").isin(own, near))
    got = {}
    for r in ann.search(frame, queries).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in (own, near):
        assert got[q] == [v for v, _ in _nearest(x, ids, q)]
    coded = spark.createDataFrame([(k % 40, b"c", 1.0, 7) for k in range(400)], ann.CODED)
    assert sorted(r["vec_id"] for r in ann.few_copies(coded, 11).collect()) == list(range(11))


@pytest.mark.parametrize("kind", ["tight groups", "far from the origin", "lattice", "scales", "odd size"])
def test_nearest_vectors_whatever_the_rows(spark, kind):
    """Rows whose codes say little of who is near, or that are equally near: the result is that of brute force."""
    random = np.random.default_rng(9)
    n = 6000
    x = {
        "tight groups": lambda: random.normal(size=(6, 32))[random.integers(0, 6, n)] + random.normal(size=(n, 32)) * 0.001,
        "far from the origin": lambda: 1000 + random.normal(size=(n, 32)),
        "lattice": lambda: random.integers(0, 2, size=(n, 16)) - 0.5,
        "scales": lambda: random.normal(size=(n, 32)) * 10.0 ** random.integers(-25, 25, size=(n, 1)),
        "odd size": lambda: random.normal(size=(n, 7)),
    }[kind]()
    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(x), pa.list_(pa.float64()))})).repartition(3)
    got = {}
    for r in ann.search(frame, frame.where("vec_id % 100 = 0"), query_block=40).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(0, n, 100):
        d = np.sqrt(np.add.accumulate((x - x[q]) ** 2, axis=1)[:, -1])
        assert got[q] == [(int(k), d[k]) for k in np.lexsort((np.arange(n), d)) if k != q][:10]


def test_queries_of_another_common_size_are_asked(spark):
    rows = [(k, [1.0 * k + 1, 1.0]) for k in range(1, 30)] + [(0, [1.0, 1.0]), (100, [1.0] * 3), (200, [2.0] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r["query_id"] for r in ann.search(frame, frame.where("vec_id % 100 = 0")).collect()} == {0}


# -- 8: urls


def test_host_rules_are_those_of_the_contract(spark):
    """The contract's list, word by word, and verdicts written out by hand, in the query and in its SQL."""
    listed = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert ", ".join(f"{r.action} {r.rule}" for r in url_filter.HOST_RULES) == listed
    want = {
        "http://a.com/en/x": ("com/en/", "block"),
        "http://www.example.com/en/7": ("example.com/en/7", "allow"),
        "http://a.net/de/8": ("net/de/", "allow"),
        "http://casino.net/de/x": ("net/de/", "allow"),
        "http://x.example.net/de/8/1": ("example.net/de/8", "block"),
        "http://example.net/de/7": ("net/de/", "allow"),
        "http://org/es/": ("org/es/", "block"),
        "http://casino.net/fr/": (None, "block"),
        "http://a.net/fr/": (None, "allow"),
    }
    frame = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in url_filter.judge(frame).orderBy("page_id").collect()] == list(want.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(want)))
    got = con.execute(f"SELECT rule, verdict FROM ({ORACLES['op8_url_filter']}) ORDER BY page_id").fetchall()
    assert got == list(want.values())


def test_urls_edge_cases(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.COM/en/x?y#z", "https://sub.example.com/en/77", "http://xexample.com/en/7", "ftp://org", "http://a.org?x=/es/", "http://a.net/de/8", "http://x.example.net/de/8/1", "http://free-bets.b.fr/", "http://com/en/", "a://b://c/d", "http://h\n.com/en/"]
    frame = spark.createDataFrame([(k, u, 1, "h") for k, u in enumerate([*urls, urls[4]])], "page_id long, url string, rule int, host string")
    got = [{c: r[c] for c in ("host", "path", "rule", "verdict")} for r in url_filter.judge(frame).orderBy("page_id").collect()]
    assert len(got) == len(urls) + 1 and got[4] == got[-1]

    def plain(url):
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in url_filter.HOST_RULES if (low == r.host or low.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.rule), default=None)
        hit = any(re.search(r.pattern, (url or "").lower()) for r in url_filter.PATTERN_RULES)
        return {"host": low, "path": path, "rule": best and best.rule, "verdict": best.action if best else "block" if hit else "allow"}

    assert got[:-1] == [plain(u) for u in urls]
    joined = [{c: r[c] for c in ("host", "path", "rule", "verdict")} for r in url_filter.judge(frame, most_inline=0).orderBy("page_id").collect()]
    assert joined == got
    assert url_filter.judge(frame.limit(0)).count() == 0


# -- 10: chats


def test_chats_edge_cases(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", "more")
    talks = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [(None, None)], 7: [("unknown", "")], 8: [("user", "hi|")], None: [c]}
    rows = [(conv, turn, *t, 9, "h") for conv, own in talks.items() for turn, t in enumerate(own)]
    frame = spark.createDataFrame([*rows, rows[0], rows[1]], "conv_id long, turn long, role string, text string, n_turns int, hashes string")
    got = {r["conv_id"]: r for r in chat_format.render(frame).collect()}
    assert set(got) == {3, 5, 6, 8, None}
    assert got[3]["n_turns"] == 3 and got[3]["n_copies"] == 2 and got[6]["n_copies"] == 2
    assert got[3]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert chat_format.render(frame.limit(0)).count() == 0


# -- shared parts


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 140), 100), 300: 300, 301: 300}


def test_pipeline_by_stages(spark):
    """Each stage keeps what its operator says of its own input; the last packs whole documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r["doc_id"]: r for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "benchmark_leaks", "secrets", "packed"]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language"](spark, docs, SF)
    assert kept.columns == docs.columns
    first = {r["doc_id"] for r in kept.collect()}
    assert first >= {d for d, r in given.items() if len(re.findall(r"[a-zà-ÿ]{2,}", (r["text"] or "").lower())) > 20}
    once = stage["near_duplicates"](spark, docs, SF).cache()
    classes = QUERIES["op4_ngram_jaccard"](spark, SF).collect()
    assert {r["doc_id"] for r in once.collect()} == {r["component_id"] for r in classes}
    clean = {r["doc_id"] for r in stage["benchmark_leaks"](spark, docs, SF).collect()}
    assert clean == set(given) - {r["doc_id"] for r in QUERIES["op3_decontaminate"](spark, SF).collect()}
    red = stage["secrets"](spark, docs, SF)
    assert red.columns == docs.columns and red.count() == len(given)
    assert secret_scan.scan(red).where("n_assign + n_access + n_hex > 0").count() == 0
    assert all(r["text"] == given[r["doc_id"]]["text"] or "[SECRET]" in r["text"] for r in red.collect())
    packed = corpus_pipeline.run(spark, SF)
    assert packed.columns == [x.split()[0] for x in packing.PACKED.split(", ")]
    assert 0 < packed.select("doc_id").distinct().count() <= len(given) and public_tokenizers
