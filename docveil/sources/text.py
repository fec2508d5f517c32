"""Text tables as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines_of(table: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, line_no, text, source): the lines of each row that are not blank.

    line_no counts from 0 and keeps the places of dropped blank lines; null texts have no lines.
    """
    at = table.select(F.col(id_column).alias("doc_id"), F.posexplode(F.split(F.col(text_column), "\n", -1)).alias("line_no", "text"))
    kept = at.where(F.trim(F.col("text"), F.lit(" \t\r\n\f\x0b")) != "")
    return kept.withColumn("source", F.concat(F.lit("line"), F.col("line_no").cast("string")))
