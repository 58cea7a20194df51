"""Formula, aggregate, lookup, window and conversion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetwright.functions import formats, numbering, scalars
from sheetwright.functions import values as V
from sheetwright.operators import lookups
from sheetwright.plans import recalc
from sheetwright.plans.columns import Compiler
from sheetwright.queries.registry import Registry, numbers, table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

_LINE = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax"}


@_r.add("SELECT l_returnflag, round(sum(l_extendedprice) FILTER (WHERE l_quantity > 25), 2) AS revenue, count(*) FILTER (WHERE l_quantity > 25)::DOUBLE AS n_lines FROM lineitem GROUP BY 1")
def formula_sumif_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    c = Compiler(df, _LINE)
    return df.groupBy("l_returnflag").agg(F.round(c.aggregate_number('=SUMIF(qty,">25",price)'), 2).alias("revenue"), c.aggregate_number('=COUNTIF(qty,">25")').alias("n_lines"))


@_r.add("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_quantity + 2.0 * 3.0 AS shifted, l_discount / 100 AS part FROM lineitem")
def formula_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    c = Compiler(df, _LINE)
    return df.select("l_orderkey", "l_linenumber", c.number("=price*(1-disc)*(1+tax)").alias("charge"), c.number("=-qty+2*3").alias("shifted"), c.number("=disc%").alias("part"))


@_r.add("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 25 THEN 0 ELSE l_extendedprice / (l_quantity - 25) END AS ratio, CASE WHEN l_quantity = 25 THEN '#DIV/0!' END AS error, CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS band FROM lineitem")
def formula_if_iferror(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    c = Compiler(df, _LINE)
    return df.select("l_orderkey", "l_linenumber", c.number("=IFERROR(price/(qty-25),0)").alias("ratio"), c.error("=price/(qty-25)").alias("error"), c.text('=IF(disc>0.05,"high","low")').alias("band"))


@_r.add("""SELECT o_orderkey, sign(o_totalprice) * floor(abs(o_totalprice) / 100 + 0.5) * 100 AS hundreds, sign(o_totalprice) * floor(abs(o_totalprice)) AS cut, floor(o_totalprice) AS whole,
 o_orderkey - (-7.0) * floor(o_orderkey / (-7.0)) AS left_over, sign(o_totalprice - 50000)::DOUBLE AS side, abs(o_totalprice - 50000) AS gap, sqrt(o_totalprice) AS root FROM orders""")
def formula_round_trunc_mod_int_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    c = Compiler(df, {"total": "o_totalprice", "key": "o_orderkey"})
    return df.select(
        "o_orderkey",
        c.number("=ROUND(total,-2)").alias("hundreds"),
        c.number("=TRUNC(total)").alias("cut"),
        c.number("=INT(total)").alias("whole"),
        c.number("=MOD(key,-7)").alias("left_over"),
        c.number("=SIGN(total-50000)").alias("side"),
        c.number("=ABS(total-50000)").alias("gap"),
        c.number("=SQRT(total)").alias("root"),
    )


@_r.add("""SELECT p_partkey, length(p_name)::DOUBLE AS n, upper(p_name) AS up, left(p_name, 4) || right(p_name, 2) AS ends, substr(p_name, 3, 5) AS middle,
 CASE WHEN strpos(p_name, 'a') = 0 THEN '#VALUE!' ELSE strpos(p_name, 'a')::VARCHAR END AS first_a, replace(p_name, 'a', '_') AS marked FROM part""")
def formula_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    c = Compiler(df, {"name": "p_name"})
    return df.select(
        "p_partkey",
        c.number("=LEN(name)").alias("n"),
        c.text("=UPPER(name)").alias("up"),
        c.text("=LEFT(name,4)&RIGHT(name,2)").alias("ends"),
        c.text("=MID(name,3,5)").alias("middle"),
        c.text('=FIND("a",name)').alias("first_a"),
        c.text('=SUBSTITUTE(name,"a","_")').alias("marked"),
    )


@_r.add("""SELECT o_orderkey, date_diff('day', DATE '1899-12-30', o_orderdate::DATE)::DOUBLE AS serial, year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, day(o_orderdate)::DOUBLE AS d,
 date_diff('day', DATE '1899-12-30', (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE)::DOUBLE AS next_month FROM orders""")
def formula_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    c = Compiler(df, {"ordered": "o_orderdate"})
    return df.select("o_orderkey", c.number("=ordered").alias("serial"), c.number("=YEAR(ordered)").alias("y"), c.number("=MONTH(ordered)").alias("m"), c.number("=DAY(ordered)").alias("d"), c.number("=DATE(YEAR(ordered),MONTH(ordered)+1,1)").alias("next_month"))


@_r.add("SELECT o_custkey, bool_and(o_totalprice > 1000) AS every, bool_or(o_orderstatus = 'F') AS any_f, NOT bool_or(o_totalprice > 300000) AS none_large FROM orders GROUP BY 1")
def formula_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    c = Compiler(df, {"total": "o_totalprice", "status": "o_orderstatus"})
    of = lambda f: V.as_boolean(c.aggregate(f))[0]
    return df.groupBy("o_custkey").agg(of("=AND(total>1000)").alias("every"), of('=OR(status="F")').alias("any_f"), of("=NOT(OR(total>300000))").alias("none_large"))


@_r.add("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, avg(l_quantity) AS mean, count(l_quantity)::DOUBLE AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(l_shipdate)::DOUBLE AS filled FROM lineitem GROUP BY ALL")
def agg_sum_avg_count_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    c = Compiler(df, _LINE)
    n = c.aggregate_number
    return df.groupBy("l_returnflag", "l_linestatus").agg(n("=SUM(qty)").alias("total"), n("=AVERAGE(qty)").alias("mean"), n("=COUNT(qty)").alias("n"), n("=MIN(price)").alias("low"), n("=MAX(price)").alias("high"), n("=COUNTA(l_shipdate)").alias("filled"))


@_r.add("SELECT p_brand, median(p_retailprice) AS middle, round(product(1 + (p_size % 3) / 1000.0), 6) AS grown FROM part GROUP BY 1")
def agg_product_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    c = Compiler(df, {"price": "p_retailprice", "size": "p_size"})
    return df.groupBy("p_brand").agg(c.aggregate_number("=MEDIAN(price)").alias("middle"), F.round(c.aggregate_number("=PRODUCT(1+MOD(size,3)/1000)"), 6).alias("grown"))


_CRITERIA = {"ge": ">=30", "le": "<=10", "ne": "<>25", "gt": ">40", "lt": "<5", "eq": "=25", "plain": "25", "words": ">many"}


@_r.add("""SELECT l_returnflag, (count(*) FILTER (WHERE l_quantity >= 30))::DOUBLE AS n_ge, (count(*) FILTER (WHERE l_quantity <= 10))::DOUBLE AS n_le, (count(*) FILTER (WHERE l_quantity <> 25))::DOUBLE AS n_ne,
 (count(*) FILTER (WHERE l_quantity > 40))::DOUBLE AS n_gt, (count(*) FILTER (WHERE l_quantity < 5))::DOUBLE AS n_lt, (count(*) FILTER (WHERE l_quantity = 25))::DOUBLE AS n_eq, (count(*) FILTER (WHERE l_quantity = 25))::DOUBLE AS n_plain,
 0::DOUBLE AS n_words, (count(*) FILTER (WHERE upper(l_linestatus) = 'O'))::DOUBLE AS n_open, coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0) AS q_f FROM lineitem GROUP BY 1""")
def countif_sumif_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    c = Compiler(df, _LINE | {"status": "l_linestatus"})
    counts = [c.aggregate_number(f'=COUNTIF(qty,"{crit}")').alias(f"n_{name}") for name, crit in _CRITERIA.items()]
    return df.groupBy("l_returnflag").agg(*counts, c.aggregate_number('=COUNTIF(status,"o")').alias("n_open"), c.aggregate_number('=SUMIF(status,"F",qty)').alias("q_f"))


@_r.add("SELECT o_orderkey, o_custkey, c_name, c_mktsegment, CASE WHEN c_name IS NULL THEN '#N/A' END AS lookup_error FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def vlookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lookups.lookup_exact(orders, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", "c_custkey", ["c_name", "c_mktsegment"])


_TIERS = [(0, 0.0, "none"), (1, 1000.0, "bronze"), (2, 50000.0, "silver"), (3, 40000.0, "copper"), (4, 150000.0, "gold"), (5, 300000.0, "platinum")]


@_r.add("""WITH t(k, low, tier) AS (VALUES (0, 0.0, 'none'), (1, 1000.0, 'bronze'), (2, 50000.0, 'silver'), (3, 40000.0, 'copper'), (4, 150000.0, 'gold'), (5, 300000.0, 'platinum'))
SELECT o_orderkey, o_totalprice, (SELECT arg_max(tier, k) FROM t WHERE k < coalesce((SELECT min(k) FROM t WHERE low > o_totalprice), 6)) AS tier, NULL::VARCHAR AS lookup_error FROM orders""")
def vlookup_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = spark.createDataFrame(_TIERS, "k int, low double, tier string")
    return lookups.lookup_near(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", tiers, "low", "k", ["tier"])


@_r.add("SELECT c_custkey, c_nationkey + 1 AS match_position, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def match_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumn("pos", F.row_number().over(Window.orderBy("n_nationkey")))
    found = lookups.match_exact(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", nation, "n_nationkey", "pos")
    cells = nation.select((F.col("pos") - 1).alias("row"), F.lit(0).alias("col"), F.col("n_name").alias("value"))
    return lookups.index_cells(found.withColumn("one", F.lit(1)), "match_position", "one", cells).select("c_custkey", "match_position", F.col("index_value").alias("name"))


@_r.add("""SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
 coalesce(max(l_extendedprice) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS below, (count(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE AS n_above
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)""")
def directional_above_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    c = Compiler(df, _LINE)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return df.select("l_orderkey", "l_linenumber", c.over_rows("=SUM(ABOVE)", w, "qty").col.alias("above"), c.over_rows("=MAX(BELOW)", w, "price").col.alias("below"), c.over_rows("=COUNT(ABOVE)", w, "qty").col.alias("n_above"))


@_r.add("""WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, unnest([0, 1, 2, 3]) AS col, unnest([l_quantity, l_linenumber::DOUBLE, (l_partkey % 100)::DOUBLE, (l_suppkey % 10)::DOUBLE]) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, col, coalesce(sum(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_sum, coalesce(min(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS right_min
FROM u WINDOW w AS (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity ORDER BY col)""")
def directional_left_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    cells = table(spark, sf_dir, "lineitem").select(*keys, F.posexplode(F.array("l_quantity", F.col("l_linenumber").cast("double"), (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 10).cast("double"))).alias("col", "v"))
    c = Compiler(cells)
    w = Window.partitionBy(*keys).orderBy("col")
    return cells.select(*keys, "col", c.over_rows("=SUM(LEFT)", w, "v").col.alias("left_sum"), c.over_rows("=MIN(RIGHT)", w, "v").col.alias("right_min"))


_NUM = r"[+-]?(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?"


@_r.add(rf"""WITH t AS (SELECT event_id AS id, props AS s FROM events UNION ALL SELECT event_id, ts::VARCHAR FROM events UNION ALL SELECT event_id, user_id::VARCHAR FROM events UNION ALL SELECT event_id, (user_id % 7)::VARCHAR || '%' FROM events
 UNION ALL SELECT event_id, '$' || user_id FROM events UNION ALL SELECT event_id, left(ts::VARCHAR, 10) FROM events UNION ALL SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN '#N/A' ELSE '' END FROM events UNION ALL SELECT event_id, user_id || '.5' FROM events)
SELECT id, s, CASE WHEN trim(coalesce(s, '')) = '' THEN 'Empty' WHEN regexp_matches(trim(s), '^#(DIV/0!|N/A!?|REF!)$') THEN 'Error' WHEN lower(trim(s)) IN ('true', 'false') THEN 'Boolean'
 WHEN regexp_matches(trim(s), '^{_NUM}\s*%$') THEN 'Percentage' WHEN regexp_matches(trim(s), '^[$]{_NUM}$') THEN 'Currency' WHEN regexp_matches(trim(s), '^-?[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]+$') THEN 'Scientific'
 WHEN regexp_matches(trim(s), '^\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}(:\d{{2}})?$') THEN 'DateTime' WHEN regexp_matches(trim(s), '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN 'Date'
 WHEN regexp_matches(trim(s), '^[+-]?\d[\d,]*$') THEN 'Integer' WHEN regexp_matches(trim(s), '^{_NUM}$') THEN 'Decimal' ELSE 'Text' END AS kind FROM t""")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    parts = ["props", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') || CASE WHEN date_format(ts, 'SSSSSS') = '000000' THEN '' ELSE rtrim('0', '.' || date_format(ts, 'SSSSSS')) END", "cast(user_id as string)", "cast(user_id % 7 as string) || '%'", "'$' || user_id", "date_format(ts, 'yyyy-MM-dd')", "CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN '#N/A' ELSE '' END", "user_id || '.5'"]
    rows = e.select(F.col("event_id").alias("id"), F.explode(F.array(*[F.expr(p) for p in parts])).alias("s"))
    return rows.select("id", "s", formats.infer_type(F.col("s")).alias("kind"))


@_r.add(r"""WITH t AS (SELECT o_orderkey AS id, unnest([o_totalprice::DECIMAL(18,2)::VARCHAR, (o_orderkey % 90)::VARCHAR || '%', '$' || (o_orderkey % 1000)::VARCHAR, o_orderstatus, CASE o_orderkey % 2 WHEN 0 THEN 'TRUE' ELSE 'false' END, '', '#REF!', '1,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0'), '12d']) AS s FROM orders)
SELECT id, s, CASE WHEN trim(s) = '' THEN 'empty' WHEN s = '#REF!' THEN 'error' WHEN upper(s) IN ('TRUE', 'FALSE') THEN 'boolean' WHEN s SIMILAR TO '[$]?[0-9,.]+%?' THEN 'number' ELSE 'text' END AS t,
 CASE WHEN s LIKE '%\%' ESCAPE '\' THEN try_cast(rtrim(s, '%') AS DOUBLE) / 100 ELSE try_cast(replace(ltrim(s, '$'), ',', '') AS DOUBLE) END AS n FROM t""")
def parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    parts = ["cast(cast(o_totalprice as decimal(18,2)) as string)", "cast(o_orderkey % 90 as string) || '%'", "'$' || cast(o_orderkey % 1000 as string)", "o_orderstatus", "CASE o_orderkey % 2 WHEN 0 THEN 'TRUE' ELSE 'false' END", "''", "'#REF!'", "'1,' || lpad(cast(o_orderkey % 1000 as string), 3, '0')", "'12d'"]
    rows = o.select(F.col("o_orderkey").alias("id"), F.explode(F.array(*[F.expr(p) for p in parts])).alias("s")).withColumn("v", V.parse_cell(F.col("s")))
    return rows.select("id", "s", F.col("v")["t"].alias("t"), F.col("v")["n"].alias("n"))


@_r.add("SELECT o_orderkey, format('{:,.0f}', floor(o_totalprice)) AS whole, format('{:,.2f}', floor(o_totalprice * 4) / 4) AS quarters, CASE WHEN o_orderkey % 2 = 0 THEN '(' || (o_orderkey % 50) || ')' ELSE (o_orderkey % 50)::VARCHAR END AS signed, lpad((o_orderkey % 1000)::VARCHAR, 5, '0') AS padded FROM orders")
def number_format_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    total = F.col("o_totalprice")
    side = F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1) * (F.col("o_orderkey") % 50)
    signed = F.when((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderkey") % 50 == 0), "(0)").otherwise(formats.column(side, "0;(0)"))
    return o.select("o_orderkey", formats.column(F.floor(total), "#,##0").alias("whole"), formats.column(F.floor(total * 4) / 4, "#,##0.00").alias("quarters"), signed.alias("signed"), formats.column(F.col("o_orderkey") % 1000, "00000").alias("padded"))


@_r.add("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS short, strftime(o_orderdate, '%A, %B %d, %Y') AS long, strftime(o_orderdate, '%d.%m.%y') AS dotted FROM orders")
def date_format_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    serial = V.to_serial(F.to_date("o_orderdate"))
    return o.select("o_orderkey", formats.column(serial, "yyyy-mm-dd").alias("short"), formats.column(serial, "dddd, mmmm dd, yyyy").alias("long"), formats.column(serial, "dd.mm.yy").alias("dotted"))


def column_letters(n):
    """A column's letters from its index, by the bijective base."""
    return numbering.column(n + 1, "UpperAlphabetic")


@_r.add("SELECT i AS index, CASE WHEN i < 26 THEN chr((65 + i)::INT) ELSE chr((64 + i // 26)::INT) || chr((65 + i % 26)::INT) END AS letters, CASE WHEN i < 26 THEN chr((65 + i)::INT) ELSE chr((64 + i // 26)::INT) || chr((65 + i % 26)::INT) END || (i + 1) AS address FROM range(0, 702) t(i)")
def a1_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbers(spark, 702)
    letters = column_letters(F.col("id"))
    return n.select(F.col("id").alias("index"), letters.alias("letters"), F.concat(letters, (F.col("id") + 1).cast("string")).alias("address"))


_ROMAN_SQL = """WITH d(k, s) AS (VALUES (0,''),(1,'i'),(2,'ii'),(3,'iii'),(4,'iv'),(5,'v'),(6,'vi'),(7,'vii'),(8,'viii'),(9,'ix')), t(k, s) AS (VALUES (0,''),(1,'x'),(2,'xx'),(3,'xxx'),(4,'xl'),(5,'l'),(6,'lx'),(7,'lxx'),(8,'lxxx'),(9,'xc'))
SELECT i AS value, repeat('c', (i // 100)::INT) || t.s || d.s AS roman, repeat(chr((97 + (i - 1) % 26)::INT), ((i - 1) // 26 + 1)::INT) AS letter,
 i || CASE WHEN i % 100 BETWEEN 11 AND 13 THEN 'th' WHEN i % 10 = 1 THEN 'st' WHEN i % 10 = 2 THEN 'nd' WHEN i % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal, lpad(i::VARCHAR, 3, '0') AS padded
FROM range(1, 201) r(i) JOIN d ON d.k = i % 10 JOIN t ON t.k = i // 10 % 10"""


@_r.add(_ROMAN_SQL)
def format_roman_letters_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = numbers(spark, 1, 201), numbering.column
    return n.select(F.col("id").alias("value"), c(F.col("id"), "LowerRoman").alias("roman"), c(F.col("id"), "LowerLetter").alias("letter"), c(F.col("id"), "Ordinal").alias("ordinal"), c(F.col("id"), "DecimalZero3").alias("padded"))


@_r.add()
def number_formats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number format, 1 to 200."""
    n = numbers(spark, 1, 201)
    return n.select(F.col("id").alias("value"), *[numbering.column(F.col("id"), name).alias(name) for name in numbering.FORMATS])


@_r.add("""WITH RECURSIVE lv AS (SELECT n_nationkey AS k, n_nationkey - 5 AS up, n_regionkey::DOUBLE AS own FROM nation), r AS (SELECT k, 0 AS depth, own AS v FROM lv WHERE up < 0 UNION ALL SELECT lv.k, r.depth + 1, r.v + lv.own FROM lv JOIN r ON lv.up = r.k)
SELECT k AS row, depth, v AS value FROM r""")
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    formula = F.when(F.col("n_nationkey") < 5, F.concat(F.lit("=A"), F.col("n_nationkey") + 1)).otherwise(F.concat(F.lit("=B"), F.col("n_nationkey") - 4, F.lit("+A"), F.col("n_nationkey") + 1))
    cells = n.select(F.lit("nation").alias("sheet"), F.explode(F.array(F.struct(F.col("n_nationkey").alias("row"), F.lit(0).alias("col"), F.col("n_regionkey").cast("string").alias("text")), F.struct(F.col("n_nationkey").alias("row"), F.lit(1).alias("col"), formula.alias("text")))).alias("c")).select("sheet", "c.*")
    return recalc.recalculate(cells).where("col = 1").select("row", "depth", F.col("n").alias("value"))


@_r.add("SELECT n_nationkey AS row, CASE WHEN n_regionkey = 0 THEN '#CYCLE!' ELSE n_nationkey::VARCHAR END AS shown FROM nation")
def cycle_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    formula = F.when(F.col("n_regionkey") == 0, F.concat(F.lit("=A"), F.col("n_nationkey") + 1)).otherwise(F.concat(F.lit("=ROW0+"), F.lit("0")))
    formula = F.when(F.col("n_regionkey") == 0, formula).otherwise(F.concat(F.lit("="), F.col("n_nationkey").cast("string")))
    cells = n.select(F.lit("nation").alias("sheet"), F.col("n_nationkey").alias("row"), F.lit(0).alias("col"), formula.alias("text"))
    return recalc.recalculate(cells).select("row", "shown")


@_r.add("""SELECT l_orderkey AS sheet, sum(l_quantity) AS total, max(l_extendedprice) AS high, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1""")
def sheet_recalculation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a sheet of its lines, with three formulas below them."""
    li = table(spark, sf_dir, "lineitem").withColumn("row", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1)
    values = li.select(F.col("l_orderkey").cast("string").alias("sheet"), "row", F.posexplode(F.array(F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"))).alias("col", "text"))
    size = li.groupBy(F.col("l_orderkey").cast("string").alias("sheet")).agg(F.count("*").cast("int").alias("n"))
    formulas = size.select("sheet", F.explode(F.array(*[F.struct(F.col("n").alias("row"), F.lit(k).alias("col"), F.concat(F.lit(head), F.col("n").cast("string"), F.lit(")")).alias("text")) for k, head in enumerate(("=SUM(A1:A", "=MAX(B1:B", "=COUNT(A1:A"))])).alias("c")).select("sheet", "c.*")
    done = recalc.recalculate(values.unionByName(formulas)).where("depth is not null")
    pick = lambda k: F.max(F.when(F.col("col") == k, F.col("n")))
    return done.groupBy(F.col("sheet").cast("long").alias("sheet")).agg(pick(0).alias("total"), pick(1).alias("high"), pick(2).alias("n"))


@_r.add("SELECT p_partkey, ceil(p_size / 7)::BIGINT AS weeks, concat_ws('/', p_brand, p_size) AS tag FROM part")
def formula_nested_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    c = Compiler(df, {"brand": "p_brand", "size": "p_size"})
    return df.select("p_partkey", c.number("=-INT(-size/7)").cast("bigint").alias("weeks"), c.text('=CONCATENATE(brand,"/",size)').alias("tag"))
