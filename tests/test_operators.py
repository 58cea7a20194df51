"""Structural, text, list, band and paging operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwright.operators import bands, codes, grid, lists, lookups, paging, text_model
from sheetwright.sources import ingest
from sheetwright.streaming import numbering as stream


@pytest.fixture(scope="module")
def cells(spark):
    rows = [("g", 0, 0, 1, 2, 1.0, 2.0), ("g", 0, 2, 2, 1, 3.0, 4.0), ("g", 1, 0, 1, 1, 5.0, 6.0), ("g", 1, 1, 1, 1, 7.0, 8.0)]
    return spark.createDataFrame(rows, "grid string, row int, col int, row_span int, col_span int, pad_left double, pad_right double")


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_grid_involutions(cells):
    for turn in (grid.flip_horizontal, grid.flip_vertical):
        assert _rows(turn(turn(cells))) == _rows(cells)
    both = cells.withColumns({"pad_top": F.lit(0.5), "pad_bottom": F.lit(0.25)})
    assert _rows(grid.transpose(grid.transpose(both))) == _rows(both)
    assert _rows(grid.delete_row(grid.insert_row(cells, 1), 1)) == _rows(cells)
    assert _rows(grid.delete_column(grid.insert_column(cells, 1), 1)) == _rows(cells)
    assert grid.flip_horizontal(cells).where("row = 0 and col = 1").first()["pad_left"] == 2.0


def test_grid_slots_and_edges(cells):
    held = grid.slots(cells)
    assert {(r["row"], r["col"]): (r["root_row"], r["root_col"]) for r in held.collect()} == {(0, 0): (0, 0), (0, 1): (0, 0), (0, 2): (0, 2), (1, 2): (0, 2), (1, 0): (1, 0), (1, 1): (1, 1)}
    e = grid.edges(held)
    assert e.count() == 3 * 3 + 2 * 4 and e.where("internal").count() == 2 and e.where("perimeter").count() == 10
    assert grid.seams(e).count() == 15


def test_grid_edges_of_a_gappy_grid_without_a_broadcast(spark):
    """Spread slots pass for as small as their cells: nothing may be broadcast whose size the planner guesses from those."""
    random = np.random.default_rng(2)
    rows = [(f"g{g}", int(r) * 2, int(c) * 3, int(random.integers(1, 3)), int(random.integers(1, 4)), 0.0, 0.0) for g in range(3) for r in range(4) for c in range(4) if random.random() < 0.6]
    rows += [(None, 0, 0, 1, 1, 0.0, 0.0)]
    cells = spark.createDataFrame(rows, "grid string, row int, col int, row_span int, col_span int, pad_left double, pad_right double")
    e = grid.edges(grid.slots(cells))
    assert not any(word in e._jdf.queryExecution().toString() for word in ("Join", "BroadcastExchange"))
    held = {(g, r + i, c + j): (r, c) for g, r, c, down, right, _, _ in rows for i in range(down) for j in range(right) if g}
    want = {(None, "horizontal", k, 0, None, None, False, True) for k in (0, 1)} | {(None, "vertical", k, 0, None, None, False, True) for k in (0, 1)}
    for g in {g for g, _, _ in held}:
        n_rows, n_cols = (1 + max(x[k] for x in held if x[0] == g) for k in (1, 2))
        for way, lines, places in (("horizontal", n_rows, n_cols), ("vertical", n_cols, n_rows)):
            for line in range(lines + 1):
                for place in range(places):
                    a, b = (held.get((g, k, place) if way == "horizontal" else (g, place, k)) for k in (line - 1, line))
                    want.add((g, way, line, place, a, b, a is not None and a == b, a is None or b is None))
    got = [(r["grid"], r["orientation"], r["line"], r["place"], r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"]), r["internal"], r["perimeter"]) for r in e.collect()]
    assert len(got) == len(want) and set(got) == want


def test_grid_merge_and_split(cells):
    merged = grid.merge_cells(cells.withColumn("n_paragraphs", F.lit(2)), 1, 0, 1, 2)
    assert merged.where("row = 1 and col = 0").first()["n_paragraphs"] == 4 and merged.count() == 3
    assert grid.split_cell(cells).count() == 6
    assert grid.subgrid(cells, 0, 1, 2, 2).select("row", "col", "row_span", "col_span").orderBy("row", "col").collect() == [(0, 0, 1, 1), (0, 1, 2, 1), (1, 0, 1, 1)]


def test_grid_placement(spark):
    rows = [("g", 1, 0, None, 2, 1), ("g", 2, 0, None, 1, 1), ("g", 3, 1, None, 1, 1), ("g", 4, 1, 1, 1, 1)]
    got = grid.place_cells(spark.createDataFrame(rows, "grid string, order int, row int, col int, row_span int, col_span int")).orderBy("order").collect()
    assert [(r["row"], r["col"]) for r in got] == [(0, 0), (0, 1), (1, 1), (1, 2)]


def test_text_edits(spark):
    docs = spark.createDataFrame([(1, "ab\r\ncd\ref"), (2, None)], "doc_id long, text string")
    paras = text_model.paragraphs(docs)
    assert {r["doc_id"]: r["text"] for r in text_model.plain_text(paras).collect()} == {1: "ab\ncd\nef", 2: ""}
    out = text_model.delete_range(text_model.insert_text(paras, F.lit(0), F.lit(1), F.lit("X\nY")), (F.lit(0), F.lit(1)), (F.lit(1), F.lit(1)))
    assert {r["doc_id"]: r["text"] for r in text_model.plain_text(out.where("doc_id = 1")).collect()} == {1: "ab\ncd\nef"}


def test_runs(spark):
    runs = spark.createDataFrame([(1, 0, 2, "a"), (1, 1, 0, "b"), (1, 2, 3, "a"), (1, 3, 1, "c")], "doc_id long, run_no int, length long, style string")
    assert [(r["style"], r["length"]) for r in text_model.coalesce_runs(runs, ["doc_id"], "run_no", "style").orderBy("run_no").collect()] == [("a", 5), ("c", 1)]
    placed = text_model.run_offsets(runs.where("length > 0"), ["doc_id"], "run_no")
    done = text_model.apply_style(placed, ["doc_id"], F.lit(1), F.lit(4), F.lit("z")).orderBy("run_no").collect()
    assert [(r["style"], r["length"]) for r in done] == [("a", 1), ("z", 3), ("a", 1), ("c", 1)]


def test_boundaries(spark):
    df = spark.createDataFrame([("a b\n日本。\u00a0", "é👍🏽x")], "s string, g string")
    assert df.select(text_model.boundary_classes(F.col("s"))).first()[0] == ["Grapheme", "WordBreak", "Grapheme", "Mandatory", "WordBreak", "Grapheme", "Grapheme", "None"]
    assert df.select(F.size(text_model.graphemes(F.col("g")))).first()[0] == 3


def test_codes_round_trip(spark):
    style = "struct<bold:boolean,font_family:string>"
    runs = spark.createDataFrame([(1, 0, 0, "a[b\t", (True, None)), (1, 0, 1, "c\\", (False, 'F"x')), (1, 2, 0, "z", (False, None))], f"doc_id long, p int, run_no int, text string, style {style}")
    paras = spark.createDataFrame([(1, 0, ("Center",)), (1, 1, ("Left",)), (1, 2, ("Left",))], "doc_id long, p int, style struct<alignment:string>")
    tokens = codes.project(runs, paras).cache()
    text = codes.projected_text(tokens).first()["projected"]
    assert text == '[Align CENTER][Bold]a\\[b[Tab][/Bold][Font "F\\"x"]c\\\\[/Font][Paragraph Break]\n[Empty Paragraph][Paragraph Break]\nz'
    rows = tokens.orderBy("seq").collect()
    assert [r["start"] for r in rows] == list(np.cumsum([0, *[len(r["text"]) for r in rows]])[:-1])
    probes = spark.createDataFrame([(1, text.index("a\\[")), (1, text.index("c\\\\")), (1, len(text) - 1)], "doc_id long, offset long")
    assert sorted((r["p"], r["source_offset"]) for r in codes.to_source(probes, tokens).collect()) == [(0, 0), (0, 4), (2, 0)]
    back = codes.to_projected(spark.createDataFrame([(1, 0, 4)], "doc_id long, p int, offset long"), tokens, last=True).first()
    assert back["projected_offset"] == text.index("c\\\\")


def test_codes_of_structure(spark):
    df = spark.createDataFrame([("a\u2028b\ufffc\u0001",)], "s string")
    assert df.select(codes.escaped(F.col("s"))).first()[0] == "a[Line Break]b[Image]\\u{0001}"


def test_list_definitions(spark):
    levels = [{"format": "UpperRoman", "template": "%1."}, {"format": "LowerLetter", "template": "%1.%2)", "legal": True}, {"format": "None", "template": "(%1.%3)"}]
    rows = [(1, k, "d", lv, rs) for k, (lv, rs) in enumerate([(0, None), (1, None), (1, None), (0, None), (1, None), (0, 7), (2, None)])]
    got = lists.number_lists(spark.createDataFrame(rows, "doc_id long, position long, definition string, level int, restart int"), {"d": {"levels": levels}}).orderBy("position").collect()
    assert [(r["label"], r["ordinal"]) for r in got[:6]] == [("I.", 1), ("1.1)", 1), ("1.2)", 2), ("II.", 2), ("2.1)", 1), ("VII.", 7)]


def test_simple_lists(spark):
    rows = [(k, kind, lv) for k, (kind, lv) in enumerate([("Number", 1), ("Number", 2), ("Number", 2), ("Number", 1), ("Number", 2), ("Bullet", 2), ("Number", 2), ("None", 0), ("Number", 1)])]
    df = spark.createDataFrame([(1, *r) for r in rows], "d int, k int, list_kind string, indent_level int")
    assert [r["label"] for r in lists.simple_labels(df, ["d"], "k").orderBy("k").collect()] == ["1.", "a.", "b.", "2.", "a.", "◦", "b.", None, "1."]


def test_lookup_near_large_and_small_agree(spark, monkeypatch):
    random = np.random.default_rng(0)
    table = spark.createDataFrame([(k, float(v), f"r{k}") for k, v in enumerate(random.integers(0, 500, 80).cumsum() - random.integers(0, 300, 80))], "k int, low double, name string")
    left = spark.createDataFrame([(k, float(v)) for k, v in enumerate(random.integers(-100, 22000, 300))], "id int, x double")
    small = _rows(lookups.lookup_near(left, "x", table, "low", "k", ["name"]).fillna("-"))
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", 0)
    assert _rows(lookups.lookup_near(left, "x", table, "low", "k", ["name"]).fillna("-")) == small
    keys = [r["low"] for r in table.orderBy("k").collect()]
    for _, x, name, err in small:
        stop = next((k for k, low in enumerate(keys) if low > x), len(keys))
        assert (name, err) == ((f"r{stop - 1}", "-") if stop else ("-", "#N/A"))


def _plain_band(top, height, left, right, obstacles):
    """Free room beside the obstacles of a line, by hand."""
    met = [o for o in obstacles if o["top"] < top + height - 0.001 and o["bottom"] > top + 0.001]
    kinds = {kind: [o for o in met if o["kind"] == kind] for kind in ("FloatLeft", "FloatRight", "Clearance", "Side")}
    left, right = max([left] + [o["right"] for o in kinds["FloatLeft"]]), min([right] + [o["left"] for o in kinds["FloatRight"]])
    shut = bool(kinds["Clearance"])
    for o in kinds["Side"]:
        a, b = max(left, o["left"]), min(right, o["right"])
        if not shut and left + 0.001 < right and a + 0.001 < b:
            left, right = (left, a) if a - left >= right - b else (b, right)
    return left, 0.0 if shut or right <= left + 0.001 else right - left


def _plain_resolved(top, height, obstacles, least):
    """Where a line of the page lands: down to the end of what blocks it, 16 times at most."""
    first = top
    for _ in range(16):
        def pushed(some, at):
            for o in some:
                at = o["bottom"] if o["top"] < at + height - 0.001 and o["bottom"] > at + 0.001 else at
            return at

        cleared = pushed([o for o in obstacles if o["kind"] != "Side"], top)
        band = _plain_band(top, height, 0.0, 100.0, obstacles)
        if cleared <= top + 0.001 and band[1] >= least:
            return top, top - first, *band
        lower = cleared if cleared > top + 0.001 else pushed(obstacles, top)
        if lower <= top + 0.001:
            break
        top = lower
    return top, top - first, 0.0, 100.0


def test_bands_against_a_fold(spark):
    random = np.random.default_rng(6)
    kinds = ["Side", "FloatLeft", "FloatRight", "Clearance"]
    obstacles = [(p, int(k), float(x), float(y), float(x + 20), float(y + 15), kinds[int(t)], "Largest", 0.0) for p in range(20) for k, (x, y, t) in enumerate(zip(random.integers(0, 90, 5), random.integers(0, 60, 5), random.choice(4, 5, p=[0.6, 0.15, 0.15, 0.1]), strict=True))]
    lines = [(p, k, float(k * 10), 8.0) for p in range(20) for k in range(8)]
    o = bands.valid_obstacles(spark.createDataFrame(obstacles, "page int, order int, left double, top double, right double, bottom double, kind string, side string, least_room double"))
    at = spark.createDataFrame(lines, "page int, line int, top double, height double")
    got = {(r["page"], r["line"]): (r["band_left"], r["band_width"]) for r in bands.compute_band(at, o, 0.0, 100.0).collect()}
    listed = {p: [r.asDict() for r in o.where(f"page = {p}").orderBy("seq").collect()] for p in range(20)}
    for p, k, top, height in lines:
        want = _plain_band(top, height, 0.0, 100.0, listed[p])
        assert got[p, k][1] == pytest.approx(want[1]) and (want[1] == 0 or got[p, k][0] == pytest.approx(want[0]))
    free = bands.free_intervals(at, o.where("kind = 'Side'"), 0.0, 100.0)
    assert free.where("band_width <= 0 or band_left < 0 or band_left + band_width > 100").count() == 0
    assert bands.resolve_lines(at, o, 0.0, 100.0, least_width=60.0).where("skip < 0").count() == 0
    moved = {(r["page"], r["line"]): (r["top"], r["skip"], r["band_left"], r["band_width"]) for r in bands.resolve_lines(at, o, 0.0, 100.0, least_width=60.0).collect()}
    assert len(moved) == len(lines)
    for p, k, top, height in lines:
        assert moved[p, k] == pytest.approx(_plain_resolved(top, height, listed[p], 60.0)), (p, k)


def test_paging(spark):
    df = spark.createDataFrame([([5.0] * 10,)], "h array<double>")
    fit = lambda start, room, orphans, widows: df.select(paging.lines_that_fit(F.col("h"), F.lit(start), F.lit(room), F.lit(orphans), F.lit(widows))).first()[0]
    assert [fit(0, 22.0, 2, 2), fit(0, 8.0, 2, 2), fit(0, 46.0, 2, 2), fit(3, 8.0, 2, 2), fit(0, 50.0, 2, 2)] == [4, 0, 8, 1, 10]
    assert paging.pack_greedily([3, 3, 9, 1], 6, 0.01) == [0, 0, 1, 2]
    height, parts = paging.balance([1.0] * 9, 3)
    assert height == pytest.approx(3, abs=0.02) and parts == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    blocks = spark.createDataFrame([(1, k, 40.0, k == 3, k == 1) for k in range(5)], "doc_id int, position int, height double, break_before boolean, keep_with_next boolean")
    assert [r["page"] for r in paging.paginate(blocks, 100.0).orderBy("position").collect()] == [0, 1, 1, 2, 2]


def test_links_and_codecs(spark):
    links = ["http://a.b/c", "HTTPS://a", "ftp://a", "#x", "#", "#a b", "mailto:x@y", "javascript:1", "", "/rel", None]
    df = spark.createDataFrame([(x,) for x in links], "s string")
    assert [r[0] for r in df.select(ingest.link_allowed(F.col("s"))).collect()] == [True, True, False, True, False, False, True, False, False, False, False]
    files = spark.createDataFrame([("<!DOCTYPE html>x",), ("%PDF-1.4",), ("",), ("plain",)], "prefix string")
    assert [(r["codec"], r["status"]) for r in ingest.select_codec(files, "prefix").collect()] == [("html", "Success"), ("pdf", "document.capability.not-composed"), (None, "document.input.unreadable"), ("text", "Success")]


def test_streamed_notes(spark, tmp_path):
    rows = [(1, k, "*" if k == 2 else None) for k in range(5)] + [(2, k, None) for k in range(2)]
    spark.createDataFrame(rows, "doc long, k long, mark string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("doc long, k long, mark string").parquet(f"{tmp_path}/in")
    q = stream.stream_note_labels(source, "doc", "k", "mark").writeStream.format("memory").queryName("notes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("notes").collect())) == [(1, 0, "1"), (1, 1, "2"), (1, 2, "*"), (1, 3, "3"), (1, 4, "4"), (2, 0, "1"), (2, 1, "2")]


@pytest.mark.parametrize(
    ("given", "affinity", "want"),
    [((10, 4, 10, 0, 2), "Default", (10, 6)), ((10, 4, 14, 0, 2), "Default", (10, 4)), ((10, 4, 10, 0, 2), "ShiftAtStart", (12, 4)), ((10, 4, 14, 0, 2), "ExpandAtEnd", (10, 6)), ((10, 4, 10, 0, 2), "StrictInterior", (12, 4)), ((10, 4, 14, 0, 2), "StrictInterior", (10, 4)), ((5, 0, 2, 0, 3), "Default", (8, 0)), ((5, 0, 10, 0, 3), "Default", (5, 0)), ((5, 0, 5, 0, 3), "ShiftAtStart", (8, 0)), ((10, 1, 10, 2, 1), "Default", (10, 0))],
)
def test_shifted_ranges(spark, given, affinity, want):
    df = spark.createDataFrame([given], "s int, c int, a int, r int, i int")
    start, count = grid.shift_range(*[F.col(x) for x in "scari"], affinity)
    assert tuple(df.select(start, count).first()) == want


def test_relocated_ranges(spark):
    cases = {(4, 2, 4, 2, 0): 0, (0, 2, 4, 2, 0): 2, (2, 2, 4, 2, 0): 4, (10, 2, 4, 2, 0): 10, (0, 2, 0, 2, 6): 4, (2, 2, 0, 2, 6): 0, (4, 2, 0, 2, 6): 2, (3, 3, 4, 2, 0): 3, (6, 0, 4, 2, 0): 2}
    df = spark.createDataFrame(list(cases), "s int, c int, a int, n int, t int")
    got = df.select("*", grid.relocate_range(*[F.col(x) for x in "scant"]).alias("to")).collect()
    assert {tuple(r)[:5]: r["to"] for r in got} == cases


def test_numbers_within_the_tolerance_are_found(spark):
    table = spark.createDataFrame([(1, 0.9999999998, "a"), (2, 1.0, "b"), (3, 5.0, "c"), (4, 1e15, "d"), (5, -2.0000000004, "e")], "k int, low double, name string")
    left = spark.createDataFrame([(0, 1.0000000005), (1, 1.0000000012), (2, 5.0000000011), (3, 1e15), (4, -2.0), (5, None)], "id int, x double")
    got = {r["id"]: (r["name"], r["lookup_error"]) for r in lookups.lookup_exact(left, "x", table, "low", "k", ["name"]).collect()}
    assert got == {0: ("a", None), 1: (None, "#N/A"), 2: (None, "#N/A"), 3: ("d", None), 4: ("e", None), 5: (None, "#N/A")}
