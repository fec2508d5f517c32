"""The key and the recall report as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The columns of a document's key file.
KEY_COLUMNS = ("placeholder", "entity_type", "original_value", "occurrences")


def key_columns(key: DataFrame) -> DataFrame:
    return key.select("doc_id", "placeholder", "entity_type", "original_value", "occurrences", "first_start")


def write_key_csv(key: DataFrame, folder: str) -> None:
    """CSV files with a header, a document's rows together and in reading order; as many files as
    the key is large, not one per document."""
    rows = key_columns(key).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "first_start", "placeholder")
    rows.drop("first_start").write.option("header", True).option("escape", '"').option("encoding", "UTF-8").mode("overwrite").csv(folder)


def key_text(key: DataFrame) -> DataFrame:
    """(doc_id, csv): each document's key as the text of one CSV file, rows in reading order."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(",", *(quoted(F.col(c).cast("string")) for c in KEY_COLUMNS))
    rows = key.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_start", "placeholder", "entity_type", line.alias("line")))).alias("rows"))
    lines = F.concat(F.array(F.lit(",".join(KEY_COLUMNS))), F.transform("rows", lambda r: r["line"]))
    return rows.select("doc_id", F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n")).alias("csv"))


def recall_rows(recall: DataFrame) -> DataFrame:
    """The report's rows with ratios of two digits, types in order and ALL last."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    rows = recall.select("entity_type", "expected", "value_hits", "typed_hits", two("value_recall").alias("value_recall"), two("typed_recall").alias("typed_recall"))
    return rows.orderBy(F.col("entity_type") == "ALL", "entity_type")


def write_recall_csv(recall: DataFrame, precision: DataFrame, folder: str) -> None:
    """``by_type`` and ``overall`` CSV folders; both are a few rows."""
    recall_rows(recall).coalesce(1).write.option("header", True).mode("overwrite").csv(f"{folder}/by_type")
    precision.coalesce(1).write.option("header", True).mode("overwrite").csv(f"{folder}/overall")


def report(recall: DataFrame) -> str:
    """The recall table as text of fixed width, for a console."""
    head = f"{'type':<18}{'expected':>9}{'value':>8}{'typed':>8}{'recall':>8}"
    rows = [f"{r.entity_type:<18}{r.expected:>9}{r.value_hits:>8}{r.typed_hits:>8}{r.value_recall:>8}" for r in recall_rows(recall).collect()]
    return "\n".join([head, *rows])
