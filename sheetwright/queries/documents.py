"""Text, projection, numbering, revision and ingest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetwright.functions import numbering
from sheetwright.operators import codes, lists, text_model
from sheetwright.queries.registry import Registry, numbers, table
from sheetwright.sources import ingest

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

_PARAS = "SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS p, unnest(l) AS text FROM (SELECT doc_id, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents)"


@_r.add(f"SELECT doc_id, p, text FROM ({_PARAS})")
def paragraph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_model.paragraphs(table(spark, sf_dir, "documents"))


@_r.add("SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents")
def plain_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_model.plain_text(text_model.paragraphs(table(spark, sf_dir, "documents")))


@_r.add(f"""WITH p AS ({_PARAS}) SELECT doc_id, p, CASE WHEN p = 0 THEN substr(text, 4) WHEN p = 2 THEN left(text, 7) ELSE text END AS text FROM p WHERE p <= 2""")
def doc_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = text_model.paragraphs(table(spark, sf_dir, "documents"))
    return text_model.slice_text(paras, (F.lit(0), F.lit(3)), (F.lit(2), F.lit(7)))


@_r.add(f"""WITH p AS ({_PARAS}) SELECT doc_id, CASE WHEN p <= 1 THEN 0 ELSE p - 1 END AS p,
 string_agg(CASE p WHEN 0 THEN left(text, 3) WHEN 1 THEN substr(text, 6) ELSE text END, '' ORDER BY p) AS text FROM p GROUP BY 1, 2""")
def doc_delete_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = text_model.paragraphs(table(spark, sf_dir, "documents"))
    return text_model.delete_range(paras, (F.lit(0), F.lit(3)), (F.lit(1), F.lit(5)))


@_r.add(f"""WITH p AS ({_PARAS}), x AS (SELECT doc_id, p, unnest(CASE WHEN p = 0 THEN [left(text, 2) || 'A', 'B' || substr(text, 3)] ELSE [text] END) AS text, unnest(CASE WHEN p = 0 THEN [0, 1] ELSE [p + 1] END) AS q FROM p)
SELECT doc_id, q AS p, text FROM x""")
def doc_insert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = text_model.paragraphs(table(spark, sf_dir, "documents"))
    return text_model.insert_text(paras, F.lit(0), F.lit(2), F.lit("A\r\nB"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("length"), "text")


@_r.add("SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations")
def run_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_model.run_offsets(_turns(spark, sf_dir), ["conv_id"], "turn").select("conv_id", "turn", "start")


@_r.add("""WITH c AS (SELECT conv_id, turn, turn // 3 AS style, length(text) AS n FROM conversations WHERE length(text) > 0), f AS (SELECT *, (style IS DISTINCT FROM lag(style) OVER w OR lag(turn) OVER w IS NULL)::INT AS new FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f) SELECT conv_id, (island - 1)::BIGINT AS run_no, any_value(style) AS style, sum(n)::BIGINT AS length, min(turn) AS first_turn FROM g GROUP BY conv_id, island""")
def run_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _turns(spark, sf_dir).withColumn("style", F.expr("turn div 3"))
    return text_model.coalesce_runs(runs, ["conv_id"], "turn", "style").select("conv_id", "run_no", "style", "length", "first_turn")


@_r.add("""WITH r AS (SELECT conv_id, turn, role AS style, length(text) AS length, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations),
 q AS (SELECT DISTINCT conv_id, unnest([0, 100, 1000, 5000])::BIGINT AS offset FROM conversations)
SELECT q.conv_id, q.offset, r.style FROM q LEFT JOIN r ON q.conv_id = r.conv_id AND q.offset >= r.start AND q.offset < r.start + r.length""")
def style_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = text_model.run_offsets(_turns(spark, sf_dir).withColumnRenamed("role", "style"), ["conv_id"], "turn")
    probes = runs.select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 100, 1000, 5000)])).alias("offset"))
    return text_model.style_at(probes, runs, ["conv_id"]).select("conv_id", "offset", "style")


@_r.add("""WITH c AS (SELECT conv_id, role, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations WHERE length(text) > 0)
SELECT conv_id, sum(greatest(0, least(s + n, 250) - greatest(s, 50)))::BIGINT AS bold_chars, sum(n)::BIGINT AS chars FROM c GROUP BY 1""")
def style_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = text_model.run_offsets(_turns(spark, sf_dir), ["conv_id"], "turn").withColumn("style", F.struct(F.col("role"), F.lit(False).alias("bold"))).select("conv_id", "start", "length", "style")
    done = text_model.apply_style(runs, ["conv_id"], F.lit(50), F.lit(250), F.struct(F.col("style")["role"].alias("role"), F.lit(True).alias("bold")))
    return done.groupBy("conv_id").agg(F.sum(F.when(F.col("style")["bold"], F.col("length")).otherwise(0)).alias("bold_chars"), F.sum("length").alias("chars"))


@_r.add("SELECT doc_id, length(regexp_replace(text, '[^ \t]', '', 'g'))::BIGINT AS word_breaks, length(regexp_replace(text, '[^\n]', '', 'g'))::BIGINT AS mandatory, length(text)::BIGINT AS clusters FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^ -~\n\tÀ-ÿ]')")
def boundary_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for every document; a null text is an empty one. The SQL can only speak for texts of plain characters."""
    d = table(spark, sf_dir, "documents")
    kinds = d.select("doc_id", text_model.boundary_classes(F.coalesce("text", F.lit(""))).alias("k"))
    count = lambda name: F.size(F.filter("k", lambda x: x == name)).cast("long")
    return kinds.select("doc_id", count("WordBreak").alias("word_breaks"), count("Mandatory").alias("mandatory"), F.size("k").cast("long").alias("clusters"))


_ESCAPE = r"replace(replace(replace(replace({0}, '\', '\\'), '[', '\['), ']', '\]'), chr(9), '[Tab]')"


@_r.add(f"SELECT doc_id, p, {_ESCAPE.format('text')} AS projected FROM ({_PARAS}) WHERE NOT regexp_matches(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2028}}-\\x{{202E}}\\x{{FEFF}}\\x{{FFFC}}]')")
def format_codes_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph; a null text is one empty paragraph. The SQL can only speak for those without control and format characters."""
    paras = text_model.paragraphs(table(spark, sf_dir, "documents"))
    return paras.select("doc_id", "p", codes.escaped(F.col("text")).alias("projected"))


def _projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a turn is a paragraph, its first ten characters are bold, the rest names its role as font."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("p"), "role", F.regexp_replace("text", "\n", " ").alias("text"))
    style = lambda bold, font: F.struct(bold.alias("bold"), font.alias("font_family"))
    parts = F.array(F.struct(F.lit(0).alias("run_no"), F.substring("text", 1, 10).alias("text"), style(F.lit(True), F.lit(None).cast("string")).alias("style")), F.struct(F.lit(1).alias("run_no"), F.expr("substring(text, 11)").alias("text"), style(F.lit(False), F.col("role")).alias("style")))
    runs = t.select("doc_id", "p", F.explode(parts).alias("r")).select("doc_id", "p", "r.*").where("text <> ''")
    paras = t.select("doc_id", "p", F.struct(F.when(F.col("role") == "user", "Right").otherwise("Left").alias("alignment")).alias("style"))
    return codes.project(runs, paras)


@_r.add(f"""WITH t AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), chr(10), ' ') AS text FROM conversations), e AS (SELECT conv_id, turn, role, text, {_ESCAPE.format('left(text, 10)')} AS a, {_ESCAPE.format('substr(text, 11)')} AS b FROM t)
SELECT conv_id AS doc_id, string_agg(CASE WHEN role = 'user' THEN '[Align RIGHT]' ELSE '' END || CASE WHEN text = '' THEN '[Empty Paragraph]' WHEN b = '' THEN '[Bold]' || a || '[/Bold]' ELSE '[Bold]' || a || '[/Bold][Font "' || role || '"]' || b || '[/Font]' END, '[Paragraph Break]' || chr(10) ORDER BY turn) AS projected FROM e GROUP BY 1""")
def format_codes_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.projected_text(_projection(spark, sf_dir))


@_r.add("""WITH t AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS n FROM conversations), w AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 13 ELSE 0 END AS head, n, CASE WHEN n > 10 THEN 10 + 13 + (9 + length(role)) ELSE 0 END AS body,
 (CASE WHEN role = 'user' THEN 13 ELSE 0 END) + CASE WHEN n = 0 THEN 17 WHEN n <= 10 THEN n + 13 ELSE n + 13 + 9 + length(role) + 7 END + 18 AS whole FROM t),
 s AS (SELECT *, coalesce(sum(whole) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM w)
SELECT conv_id AS doc_id, turn::INT AS p, (base + head + 6 + 5)::BIGINT AS offset, 5::BIGINT AS source_offset FROM s WHERE n > 10""")
def offset_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth character of every turn, from its place in the projection."""
    tokens = _projection(spark, sf_dir)
    first = tokens.where("kind = 'Text'").groupBy("doc_id", "p").agg(F.min(F.struct("start", "length")).alias("t"))
    turns = table(spark, sf_dir, "conversations").where(F.length("text") > 10).select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("p"))
    probes = first.join(turns, ["doc_id", "p"]).select("doc_id", (F.col("t")["start"] + 5).alias("offset"))
    return codes.to_source(probes, tokens)


@_r.add("""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Number' WHEN 'system' THEN 'None' ELSE CASE WHEN turn % 3 = 0 THEN 'Bullet' ELSE 'Number' END END AS kind, CASE role WHEN 'user' THEN 1 ELSE 2 END AS lvl FROM conversations),
 g AS (SELECT *, sum((kind = 'None')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS l FROM c), h AS (SELECT *, sum((kind <> 'None' AND lvl < 2)::INT) OVER (PARTITION BY conv_id, l ORDER BY turn) AS cut2 FROM g),
 n AS (SELECT *, sum((kind = 'Number' AND lvl = 1)::INT) OVER (PARTITION BY conv_id, l ORDER BY turn) AS n1, sum((kind = 'Number' AND lvl = 2)::INT) OVER (PARTITION BY conv_id, l, cut2 ORDER BY turn) AS n2 FROM h)
SELECT conv_id, turn, CASE WHEN kind = 'None' THEN NULL WHEN kind = 'Bullet' THEN CASE lvl WHEN 1 THEN '•' ELSE '◦' END WHEN lvl = 1 THEN n1 || '.' WHEN n2 <= 26 THEN chr((96 + n2)::INT) || '.' ELSE chr((96 + (n2 - 1) // 26)::INT) || chr((97 + (n2 - 1) % 26)::INT) || '.' END AS label FROM n""")
def list_numbering_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "Number").when(F.col("role") == "system", "None").when(F.col("turn") % 3 == 0, "Bullet").otherwise("Number")
    items = c.select("conv_id", "turn", kind.alias("list_kind"), F.when(F.col("role") == "user", 1).otherwise(2).alias("indent_level"))
    return lists.simple_labels(items, ["conv_id"], "turn").select("conv_id", "turn", "label")


_OUTLINE = {"outline": {"levels": [{"format": "UpperRoman", "template": "%1."}, {"format": "Decimal", "template": "%1.%2", "legal": True}, {"format": "LowerAlphabetic", "template": "%3)"}]}}


@_r.add("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 0 ELSE 1 END AS lvl FROM events), a AS (SELECT *, sum((lvl = 0)::INT) OVER w AS first, first_value(lvl) OVER w AS head FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 b AS (SELECT *, sum((lvl = 1)::INT) OVER (PARTITION BY user_id, first ORDER BY event_id) AS second FROM a)
SELECT user_id AS doc_id, event_id AS position, (CASE lvl WHEN 0 THEN first + head ELSE second END)::INT AS ordinal FROM b""")
def list_numbering_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    least = e.agg(F.min("event_type").alias("least"))
    items = e.crossJoin(F.broadcast(least)).select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("position"), F.lit("outline").alias("definition"), F.when(F.col("event_type") == F.col("least"), 0).otherwise(1).alias("level"), F.lit(None).cast("int").alias("restart"))
    return lists.number_lists(items, _OUTLINE).select("doc_id", "position", "ordinal")


@_r.add("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN '*' END AS mark FROM events), n AS (SELECT *, count(*) FILTER (WHERE mark IS NULL) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e)
SELECT event_id, coalesce(mark, k::VARCHAR) AS label, CASE WHEN mark IS NULL THEN k END AS number FROM n""")
def note_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 == 0, "*").alias("mark"))
    return text_model.note_labels(e, ["user_id"], "event_id", "mark").select("event_id", "label", "number")


@_r.add("""WITH n AS (SELECT event_id, event_type, sum((event_type <> 'view')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT event_id, CASE WHEN event_type <> 'view' THEN k END::BIGINT AS line_number, event_type <> 'view' AND k % 5 = 0 AS shown FROM n""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return text_model.line_numbers(e, ["user_id"], "event_id", F.col("event_type") != "view", every=5).select("event_id", "line_number", "shown")


@_r.add("SELECT user_id AS author, ((row_number() OVER (ORDER BY min(event_id), user_id) - 1) % 9)::INT AS colour FROM events GROUP BY user_id")
def revision_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_model.author_colours(table(spark, sf_dir, "events").withColumnRenamed("user_id", "author"), "author", "event_id")


@_r.add("""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN '' ELSE text END AS text, (turn % 3 = 1) AS gone FROM conversations), s AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY conv_id ORDER BY turn), false) AS joined FROM c), g AS (SELECT *, sum((NOT joined)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM s)
SELECT conv_id AS doc_id, (chain - 1)::INT AS p, string_agg(text, '' ORDER BY turn) AS text FROM g GROUP BY conv_id, chain""")
def accept_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnsRenamed({"conv_id": "doc_id", "turn": "p"})
    gone = F.col("p") % 3 == 1
    runs = c.select("doc_id", "p", F.lit(0).alias("run_no"), "text", ((F.col("role") == "assistant") & gone).alias("deleted"))
    marks = c.select("doc_id", "p", gone.alias("mark_deleted"), F.lit(False).alias("boundary"))
    return text_model.accept_deletions(runs, marks).select("doc_id", "p", "text")


@_r.add("""WITH s AS (SELECT user_id, (event_id // 100) AS page, event_id, props AS text FROM events WHERE event_type = 'click'), pages AS (SELECT DISTINCT user_id, event_id // 100 AS page FROM events)
SELECT p.user_id, p.page, coalesce((SELECT arg_min(text, event_id) FROM s WHERE s.user_id = p.user_id AND s.page = p.page), (SELECT arg_max(text, event_id) FROM s WHERE s.user_id = p.user_id AND s.page < p.page), (SELECT arg_min(text, event_id) FROM s WHERE s.user_id = p.user_id AND s.page > p.page)) AS shown FROM pages p""")
def style_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("page", F.expr("event_id div 100"))
    stretches = e.where("event_type = 'click'").select("user_id", "page", F.col("event_id").alias("position"), F.col("props").alias("text"))
    return text_model.resolve_references(e.select("user_id", "page").distinct(), stretches, ["user_id"])


@_r.add("SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS resolved_header FROM events")
def running_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 == 0, F.col("props")).alias("header"))
    return text_model.carry_forward(e, ["user_id"], "event_id", "header").select("event_id", "resolved_header")


_LINKS = "unnest([url, '#top', '#a b', replace(url, 'http', 'ftp'), '', 'mailto:' || page_id || '@example.com', split_part(url, '://', 2)])"


@_r.add(f"WITH l AS (SELECT page_id, {_LINKS} AS link FROM pages) SELECT page_id, link, link <> '' AND (regexp_matches(link, '^#[^\"#\\s]+$') OR regexp_matches(link, '^https?://[^\\s/?#]+([/?#]\\S*)?$', 'i') OR regexp_matches(link, '^mailto:\\S+$', 'i')) AS allowed FROM l")
def link_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    links = F.array("url", F.lit("#top"), F.lit("#a b"), F.replace("url", F.lit("http"), F.lit("ftp")), F.lit(""), F.concat(F.lit("mailto:"), "page_id", F.lit("@example.com")), F.call_function("split_part", F.col("url"), F.lit("://"), F.lit(2)))
    return p.select("page_id", F.explode(links).alias("link")).select("page_id", "link", ingest.link_allowed(F.col("link")).alias("allowed"))


@_r.add("""WITH i AS (SELECT 'p' || page_id AS id, html AS t FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents UNION ALL SELECT 'b' || item_id, '%PDF-1.7 ' || text FROM benchmark UNION ALL SELECT 'e' || item_id, '' FROM benchmark)
SELECT id, CASE WHEN regexp_matches(left(t, 4096), '^\\s*<!doctype html|^\\s*<html', 'i') THEN 'html' WHEN t LIKE '%PDF-%' AND left(t, 5) = '%PDF-' THEN 'pdf' WHEN regexp_matches(left(t, 4096), '^\\s*[\\[{]') THEN 'json'
 WHEN regexp_matches(left(t, 4096), '(?m)^(#{1,6} |\\* |- )') THEN 'markdown' WHEN regexp_matches(left(t, 4096), '^[^\\n|]* \\| ') THEN 'table' WHEN length(t) > 0 THEN 'text' END AS codec,
 CASE WHEN left(t, 5) = '%PDF-' THEN 'document.capability.not-composed' WHEN length(t) = 0 THEN 'document.input.unreadable' ELSE 'Success' END AS status FROM i""")
def codec_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name, key, letter, text: table(spark, sf_dir, name).select(F.concat(F.lit(letter), key).alias("id"), text.alias("t"))
    b = F.concat(F.lit("%PDF-1.7 "), F.col("text"))
    inputs = read("pages", "page_id", "p", F.col("html")).unionByName(read("documents", "doc_id", "d", F.col("text"))).unionByName(read("benchmark", "item_id", "b", b)).unionByName(read("benchmark", "item_id", "e", F.lit("")))
    return ingest.select_codec(inputs, "t").select("id", "codec", "status")


@_r.add("""WITH d AS (SELECT doc_id, length(text) AS n, length(text) - length(replace(text, chr(10), '')) + 1 AS p FROM documents) SELECT doc_id, CASE WHEN n > 5000 THEN 'document.limit.run' WHEN p > 40 THEN 'document.limit.paragraphs' END AS finding, CASE WHEN n > 5000 OR p > 40 THEN 'Partial' ELSE 'Success' END AS status FROM d""")
def limits_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    found = ingest.limit_findings(F.length("text"), F.size(F.split("text", "\n", -1)), 5000, 40)
    return d.select("doc_id", found.alias("finding")).withColumn("status", F.when(F.col("finding").isNotNull(), "Partial").otherwise("Success"))


@_r.add("""WITH d AS (SELECT doc_id, list_filter(['Title', 'Author', 'Subject', 'Keywords', 'Created'], lambda x, i: (doc_id >> i) % 2 = 1) AS f FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter(f, lambda x: x NOT IN ('Subject', 'Keywords'))), ',') AS kept, array_to_string(list_sort(list_filter(f, lambda x: x IN ('Subject', 'Keywords'))), ',') AS lost, array_to_string(list_filter(f, lambda x: x = 'Created'), ',') AS narrowed FROM d""")
def metadata_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("Title", "Author", "Subject", "Keywords", "Created")))
    stated = F.filter(names, lambda x, i: F.call_function("shiftright", F.col("doc_id"), i + 1) % 2 == 1)
    d = table(spark, sf_dir, "documents").select("doc_id", stated.alias("f"))
    kept, lost, narrowed = ingest.metadata_report(F.col("f"), F.array(F.lit("Subject"), F.lit("Keywords")), F.array(F.lit("Created")))
    return d.select("doc_id", F.array_join(kept, ",").alias("kept"), F.array_join(lost, ",").alias("lost"), F.array_join(narrowed, ",").alias("narrowed"))


@_r.add("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE '' END AS shown, event_id % 2 = 0 AS has_zone, event_id % 3 <> 0 AS readable FROM events""")
def w3c_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(even, "Z").otherwise(""))
    given = F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("?"))).otherwise(text)
    return e.select("event_id", text.alias("shown"), even.alias("has_zone"), ingest.parse_timestamp(given).isNotNull().alias("readable"))


@_r.add("SELECT p_partkey, CASE WHEN p_partkey % 5 - 1 + 1 < 1 THEN '' ELSE (p_partkey % 5)::VARCHAR END AS field FROM part")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetwright.operators import paging

    return table(spark, sf_dir, "part").select("p_partkey", paging.page_field((F.col("p_partkey") % 5 - 1).cast("int"), F.lit(1)).alias("field"))


@_r.add()
def circled_greek_hebrew_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbers(spark, 1, 101)
    return n.select(F.col("id").alias("value"), *[numbering.column(F.col("id"), k).alias(k) for k in ("CircledNumber", "GreekLower", "HebrewNumber", "IdeographCounting")])


@_r.add("""WITH u(k, w) AS (VALUES (1,'one'),(2,'two'),(3,'three'),(4,'four'),(5,'five'),(6,'six'),(7,'seven'),(8,'eight'),(9,'nine'),(10,'ten'),(11,'eleven'),(12,'twelve'),(13,'thirteen'),(14,'fourteen'),(15,'fifteen'),(16,'sixteen'),(17,'seventeen'),(18,'eighteen'),(19,'nineteen')), t(k, w) AS (VALUES (2,'twenty'),(3,'thirty'),(4,'forty'),(5,'fifty'),(6,'sixty'),(7,'seventy'),(8,'eighty'),(9,'ninety')),
 n AS (SELECT i, CASE WHEN i = 100 THEN 'one hundred' WHEN i < 20 THEN u.w WHEN i % 10 = 0 THEN t.w ELSE t.w || '-' || d.w END AS w FROM range(1, 101) r(i) LEFT JOIN u ON u.k = i LEFT JOIN t ON t.k = i // 10 LEFT JOIN u d ON d.k = i % 10)
SELECT i AS value, upper(left(w, 1)) || substr(w, 2) AS words FROM n""")
def cardinal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = numbers(spark, 1, 101)
    return n.select(F.col("id").alias("value"), numbering.column(F.col("id"), "CardinalText").alias("words"))
