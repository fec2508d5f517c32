"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, token ids.

Stages take documents as they are: any column may be null, rows and doc_ids may repeat, texts may be
empty or very long, and columns beyond those of documents are dropped. Decisions are made per row,
not per doc_id. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.llm.common import table, written
from docveil.llm.decontaminate import decontaminate
from docveil.llm.near_dedup import near_duplicates
from docveil.llm.pieces import Dropout, encode_pieces
from docveil.llm.pii import masked, pii_spans
from docveil.llm.quality import ACCEPT, fit, scored
from docveil.llm.queries import piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier accepts.

    It is fitted on the whole documents and labels tables, whatever ``docs`` holds. A null or blank
    text scores 0 and goes, unless there are no labels of both kinds; repeated rows score alike.
    Ties with the threshold stay.
    """
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored(docs.select(*COLUMNS), model).where(F.col("quality_score") >= ACCEPT).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a ``row`` number of their own, as ids may be null or repeat."""
    return written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest id, of each group of near-duplicates.

    Rows that share an id are told apart: repeated rows leave one, and rows of one id with other
    texts are judged by these. Rows without an id are linked with nothing and stay, as in the
    operator, and so do null and blank texts. Of equal ids in a group any one row stays.
    """
    rows = numbered(docs)
    known = rows.where("doc_id is not null")
    near = near_duplicates(known.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    near = written(near, "near")
    best = near.join(known.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("best"))
    gone = near.join(best.select("best.row"), "row", "left_anti").select("row")
    return rows.join(written(gone, "gone"), "row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a passage of the benchmark, whether or not row or item has an id.

    Null and empty texts hold none and stay; repeated rows go or stay alike; without a benchmark all
    stay.
    """
    rows = numbered(docs)
    items = table(spark, sf_dir, "benchmark").withColumn("item_id", F.monotonically_increasing_id())
    found = decontaminate(rows.select(F.col("row").alias("doc_id"), "text"), items).documents
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("row"))
    return rows.join(written(hit, "hit"), "row", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by placeholders; n_chars follows the text where it changed.

    All rows stay; a null text stays null. Of overlapping spans one placeholder stands for all.
    """
    found = docs.select(*COLUMNS).withColumn("spans", pii_spans(F.col("text")))
    changed = found.withColumn("text", masked(F.col("text"), F.col("spans")))
    n = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", n).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and the ids of each document.

    A null text has null ids and 0 pieces, an empty one no ids. The draws are keyed by doc_id (0 if
    null), so repeated rows are cut alike.
    """
    r = encode_pieces(docs.select(*COLUMNS), Dropout(piece_model()))
    return r.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: The classifier, MinHash and merge-dropout are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
