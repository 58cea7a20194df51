"""Rules, edits, splices and workbook queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetwright.functions import values as V
from sheetwright.operators import documents, rules, text_model
from sheetwright.queries.registry import Registry, table
from sheetwright.sources import ingest

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


@_r.add("SELECT o_orderkey FROM orders WHERE upper(o_orderstatus) IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def auto_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where(rules.passes_filter(F.col("o_orderstatus"), ["f", "p"], False) & rules.passes_filter(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], True)).select("o_orderkey")


@_r.add("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity BETWEEN 5 AND 45 AND floor(l_quantity) = l_quantity AS whole, NOT (l_discount BETWEEN 0.02 AND 0.05) AS outside, l_returnflag IN ('A', 'N') AS listed, length(l_linestatus) = 1 AS short FROM lineitem")
def data_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    of = lambda c: V.of_column(c, li.schema[c].dataType)
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        rules.is_valid(of("l_quantity"), "WholeNumber", "Between", 5, 45).alias("whole"),
        rules.is_valid(of("l_discount"), "Decimal", "NotBetween", 0.02, 0.05).alias("outside"),
        rules.is_valid(of("l_returnflag"), "List", listed=["a", "n"]).alias("listed"),
        rules.is_valid(of("l_linestatus"), "TextLength", "Equal", 1).alias("short"),
    )


@_r.add("""WITH p AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size) > 1 AS dup, (p_size - min(p_size) OVER w) / nullif(max(p_size) OVER w - min(p_size) OVER w, 0)::DOUBLE AS f FROM part WINDOW w AS (PARTITION BY p_brand))
SELECT p_partkey, CASE WHEN p_retailprice > 1500 THEN 'dear' WHEN upper(p_name) LIKE 'A%' THEN 'a' WHEN dup THEN 'twice' END AS format, 'FF' || printf('%02X', floor(255 + (0 - 255) * coalesce(f, 0) + 0.5)::INT) || printf('%02X', floor(0 + 128 * coalesce(f, 0) + 0.5)::INT) || '00' AS colour FROM p""")
def conditional_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rules.colour_scale(rules.repeated_values(table(spark, sf_dir, "part"), ["p_brand"], "p_size"), ["p_brand"], "p_size", (255, 0, 0), (0, 128, 0))
    of = lambda c: V.of_column(c, p.schema[c].dataType)
    listed = [(rules.matches_rule(of("p_retailprice"), "CellIs", "GreaterThan", 1500), "dear"), (rules.matches_rule(of("p_name"), "BeginsWith", first="a"), "a"), (F.col("duplicate"), "twice")]
    return p.select("p_partkey", rules.first_format(listed).alias("format"), "colour")


@_r.add("""SELECT event_id, CASE WHEN event_id % 700 > 512 OR event_id % 700 < 1 THEN 'FCEDIT021' WHEN event_id % 11 = 0 THEN 'FCEDIT024' END AS inline_code, CASE WHEN event_id % 5 = 0 THEN 'FCEDIT034' WHEN event_id % 150 > 100 THEN 'FCEDIT030' WHEN event_id % 7 = 0 THEN 'FCEDIT031' END AS paragraph_code FROM events""")
def edit_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, none = table(spark, sf_dir, "events"), F.lit(None).cast("string")
    k = F.col("event_id")
    size, zero = (k % 700).cast("double"), F.lit(None).cast("double")
    inline = rules.inline_code(none, size, none, zero, zero, F.when(k % 11 == 0, "e").otherwise("en-US"), none)
    block = rules.paragraph_code(F.when(k % 5 == 0, "Middle").otherwise("Left"), none, k % 150, F.when(k % 7 == 0, 0.0).otherwise(1.5), zero, zero)
    return e.select("event_id", inline.alias("inline_code"), block.alias("paragraph_code"))


@_r.add(r"""WITH t AS (SELECT o_orderkey AS id, unnest(['$' || (o_orderkey % 500), (o_orderkey % 40) || '%', strftime(o_orderdate, '%Y-%m-%d'), 'yes', 'N', 'abc', (30000 + o_orderkey % 9000)::VARCHAR]) AS s FROM orders)
SELECT id, s, CASE WHEN s LIKE '%\%' ESCAPE '\' THEN try_cast(rtrim(s, '%') AS DOUBLE) / 100 WHEN regexp_matches(s, '^\d{4}-\d{2}-\d{2}$') THEN date_diff('day', DATE '1899-12-30', s::DATE)::DOUBLE ELSE try_cast(ltrim(s, '$') AS DOUBLE) END AS n,
 CASE WHEN upper(s) IN ('YES', 'Y', 'TRUE', '1') THEN true WHEN upper(s) IN ('NO', 'N', 'FALSE', '0') THEN false END AS b,
 strftime(CASE WHEN regexp_matches(s, '^\d{4}-') THEN s::DATE WHEN regexp_matches(s, '^\d+$') THEN DATE '1899-12-30' + s::INT END, '%Y-%m-%d') AS d FROM t""")
def coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    parts = ["'$' || (o_orderkey % 500)", "(o_orderkey % 40) || '%'", "date_format(o_orderdate, 'yyyy-MM-dd')", "'yes'", "'N'", "'abc'", "cast(30000 + o_orderkey % 9000 as string)"]
    rows = o.select(F.col("o_orderkey").alias("id"), F.explode(F.array(*[F.expr(p) for p in parts])).alias("s"))
    s = F.col("s")
    return rows.select("id", "s", rules.to_double(s).alias("n"), rules.to_boolean(s).alias("b"), rules.to_day(s).cast("string").alias("d"))


@_r.add("""WITH p AS (SELECT conv_id, turn, text FROM conversations), n AS (SELECT (row_number() OVER (ORDER BY item_id) - 1)::INT AS k, text FROM benchmark WHERE item_id < 3)
SELECT conv_id AS doc_id, (CASE WHEN turn >= 1 THEN turn + (SELECT count(*) FROM n) ELSE turn END)::BIGINT AS p, text FROM p UNION ALL SELECT d.conv_id, (1 + n.k)::BIGINT, n.text FROM (SELECT DISTINCT conv_id FROM conversations) d, n""")
def document_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("p"), "text")
    inserted = table(spark, sf_dir, "benchmark").where("item_id < 3").select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("p"), "text")
    out = documents.insert_document(target, inserted, F.lit(1))
    return out.select("doc_id", F.col("p").cast("bigint").alias("p"), "text")


@_r.add("""WITH s AS (SELECT *, coalesce(lag(turn % 2 = 0) OVER (PARTITION BY conv_id ORDER BY turn), false) AS joined FROM conversations), g AS (SELECT *, sum((NOT joined)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM s)
SELECT conv_id AS doc_id, (chain - 1)::INT AS p, string_agg(text || CASE WHEN turn % 2 = 0 THEN chr(8233) ELSE '' END, '' ORDER BY turn) AS text FROM g GROUP BY conv_id, chain""")
def joined_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("p"), "text", (F.col("turn") % 2 == 0).alias("mark_deleted"), F.lit(False).alias("boundary"))
    return documents.join_deleted_breaks(c).select("doc_id", "p", "text")


@_r.add("SELECT user_id AS doc_id, event_type AS section, count(DISTINCT event_id // 50) AS n_pages FROM events GROUP BY ALL")
def section_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("section"), F.expr("event_id div 50").alias("page"))
    return documents.section_pages(lines)


@_r.add("SELECT conv_id AS doc_id, turn AS p, CASE WHEN turn % 4 < 3 THEN turn // 4 END AS section FROM conversations")
def section_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("p"))
    sections = paras.where("p % 4 = 0").select("doc_id", F.expr("p div 4").alias("section"), F.col("p").alias("first_paragraph"), F.lit(3).alias("n_paragraphs"))
    return documents.sections_of(paras, sections)


@_r.add("""WITH l AS (SELECT n_regionkey AS sheet_no, n_nationkey AS row, unnest(string_split(n_name || chr(10) || n_nationkey, chr(10))) AS text, unnest([0, 1]) AS k FROM nation)
SELECT row_number() OVER (ORDER BY sheet_no, row, k) - 1 AS p, sheet_no, row, text FROM l""")
def workbook_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("sheet_no"), F.col("n_nationkey").alias("row"), F.lit(0).alias("col"), F.concat("n_name", F.lit("\n"), F.col("n_nationkey").cast("string")).alias("text"))
    return ingest.document_paragraphs(n).select("p", "sheet_no", "row", "text")


@_r.add("""WITH c AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id AS doc_id, (turn // 2)::BIGINT AS row, string_agg(text, chr(10) ORDER BY turn) AS text FROM c GROUP BY conv_id, turn // 2""")
def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("p"), "text")
    cells = paras.where("p % 2 = 0").select("doc_id", F.lit("S").alias("sheet"), F.expr("p div 2").alias("row"), F.lit(0).alias("col"), F.col("p").alias("first_paragraph"), F.lit(2).alias("n_paragraphs"))
    return ingest.workbook_cells(paras, cells).select("doc_id", "row", "text")


@_r.add("SELECT p_partkey, upper(p_name) AS caps, lower(p_name) AS small FROM part")
def capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", rules.capitalise(F.col("p_name"), "AllCaps").alias("caps"), rules.capitalise(F.col("p_name"), "Lowercase").alias("small"))


@_r.add("SELECT event_id, (event_id % 8)::BIGINT AS operations, event_id % 3 <> 0 AND ((event_id % 4 + 4) & (event_id % 8)) = event_id % 8 AS allowed FROM events")
def resource_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    requests = e.select("event_id", F.col("event_id").alias("resource_id"), F.lit("d").alias("digest"), (F.col("event_id") % 8).alias("operations"))
    known = e.select(F.col("event_id").alias("resource_id"), F.when(F.col("event_id") % 3 == 0, "other").otherwise("d").alias("digest"), (F.col("event_id") % 4 + 4).alias("permitted"))
    return ingest.permitted(requests, known).select("event_id", "operations", "allowed")


@_r.add("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'bold' WHEN event_id % 4 = 1 THEN 'underline' WHEN event_id % 4 = 2 THEN 'strike' ELSE 'none' END AS shown FROM events")
def revision_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    kind = F.when(k == 0, "Format").when(k == 1, "Insertion").when(k == 2, "Deletion").otherwise("Plain")
    return table(spark, sf_dir, "events").select("event_id", text_model.decorate(kind, F.lit(False)).alias("shown"))
