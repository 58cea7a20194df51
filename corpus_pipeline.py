"""The corpus pipeline: five operators in a row over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all rows its predecessor kept and returns a DataFrame. All but the
last return the columns of documents.

Edge cases, for every stage: other columns than those of documents are dropped,
whatever their names; an empty table gives no rows; texts of any length are
judged whole. A null or empty text has no language, so the first stage drops
it; the others, given one, keep it. Rows are judged one by one, also where ids
are null or repeat, but for near_duplicates, which says what it does with them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.llm import decontaminate, language_id, ngram_join, packing, secret_scan
from sheetwright.llm.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Below this share of its letters, of whatever script, in one language, a document is rejected.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or none with a real share of them. lang becomes the prediction."""
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs.select("doc_id", "text", "lang").where(~language_id.held_out()))
    return language_id.judged(docs, model).where((F.col("lang_pred") != language_id.UND) & (F.col("lang_share") >= LEAST_SHARE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with row_key, a hash of ``columns`` and of which of them are null: ids may be null or repeated."""
    return docs.select(*COLUMNS).withColumn("row_key", F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that with the smallest id; documents without words are alone.

    Null ids come last; among rows with one id one stays, and rows that agree in all columns are one row repeated.
    """
    rows = _keyed(docs, *COLUMNS)
    found = ngram_join.classes(rows.select(F.col("row_key").alias("doc_id"), "text")).where("n_shingles > 0")
    members = found.groupBy(F.col("doc_id").alias("row_key")).agg(F.first("component_id").alias("component_id"), F.count("*").alias("n_rows"))
    members = members.join(rows.groupBy("row_key").agg(F.min("doc_id").alias("doc_id")), "row_key")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first"))
    stays = F.col("first")["row_key"] == F.col("row_key")
    decided = members.join(first, "component_id").where(~stays | (F.col("n_rows") > 1)).select("row_key", stays.alias("stays"))
    decided = Workspace(spark, "near-duplicates").save(decided, "decided")
    out = rows.join(decided, "row_key", "left_anti").select(*COLUMNS)
    repeated = decided.where("stays")
    if repeated.isEmpty():
        return out
    return out.union(rows.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark. The text alone decides, whatever the id."""
    rows = _keyed(docs, "text")
    found = decontaminate.contaminated(rows.select(F.col("row_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("doc_id").alias("row_key")).distinct(), "row_key", "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows the text."""
    return secret_scan.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("packed", packed),
]

#: Language models and packing are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    space = Workspace(spark, "pipeline")
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        made = space.save(stage(spark, docs, sf_dir), name)
        if held is not None:
            space.drop(held)
        docs = held = made
    return docs
