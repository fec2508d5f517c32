"""Entities to tokens, the re-identification key, rewritten text, counts and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docveil.functions import spans as S
from docveil.functions.masks import Policy
from docveil.operators.registry import prefix_of


def key_table(entities: DataFrame, policy: Policy | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, placeholder, entity_type, original_value, occurrences, first_start, first_end,
    is_ambiguous): a row per distinct value of a type in a document.

    A mask of the policy is the token; other values are numbered per prefix in reading order, and
    only they move the counter. Values are aggregated before the numbering, so that window holds
    distinct values only. A token that several values share is ambiguous.
    """
    value = entities.groupBy("doc_id", "entity_type", F.col("text").alias("original_value")).agg(F.min(F.struct("start", "end")).alias("first"), F.count("*").alias("occurrences"))
    mask = policy.render(F.col("entity_type"), F.col("original_value")) if policy else F.lit(None).cast("string")
    value = value.withColumn("mask", mask).withColumn("prefix", prefix_of(F.col("entity_type"), overrides))
    # Masked values come last in their window and so move no number.
    order = Window.partitionBy("doc_id", "prefix").orderBy(F.col("mask").isNotNull(), "first", "entity_type", "original_value")
    numbered = F.concat(F.lit("["), F.col("prefix"), F.lit("_"), F.row_number().over(order).cast("string"), F.lit("]"))
    value = value.withColumn("placeholder", F.coalesce("mask", numbered))
    same = F.count("*").over(Window.partitionBy("doc_id", "placeholder"))
    return value.select("doc_id", "placeholder", "entity_type", "original_value", "occurrences", F.col("first.start").alias("first_start"), F.col("first.end").alias("first_end"), (same > 1).alias("is_ambiguous"))


def with_tokens(found: DataFrame, policy: Policy | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """``found`` (doc_id, line_no, text, source, offset, entities) with ``entities`` that have tokens.

    A value's number is its rank among the first places of its prefix's values in the document, so
    the entities need not be joined with their key, nor detected for it again: the windows are all
    of a document, by which the lines are dealt already. A line's text goes with its first entity.
    """
    rows = found.select("doc_id", "line_no", "source", "offset", "text", F.posexplode_outer("entities").alias("i", "e"))
    rows = rows.withColumn("text", F.when(F.coalesce("i", F.lit(0)) == 0, F.col("text")))
    value = [F.col("e.entity_type"), F.col("e.text")]
    mask = policy.render(*value) if policy else F.lit(None).cast("string")
    at = F.struct((F.col("offset") + F.col("e.start")).alias("start"), (F.col("offset") + F.col("e.end")).alias("end"))
    rows = rows.withColumn("mask", mask).withColumn("prefix", prefix_of(F.col("e.entity_type"), overrides)).withColumn("at", F.when(F.col("e").isNotNull(), at))
    rows = rows.withColumn("first", F.min("at").over(Window.partitionBy("doc_id", "e.entity_type", "e.text")))
    order = Window.partitionBy("doc_id", "prefix").orderBy(F.col("mask").isNotNull(), "first", "e.entity_type", "e.text")
    token = F.coalesce("mask", F.concat(F.lit("["), F.col("prefix"), F.lit("_"), F.dense_rank().over(order).cast("string"), F.lit("]")))
    span = F.struct("e.start", "e.end", "e.entity_type", "e.score", "e.text", token.alias("token"))
    rows = rows.withColumn("span", F.when(F.col("e").isNotNull(), span))
    one = F.array_sort(F.collect_list("span"))
    return rows.groupBy("doc_id", "line_no").agg(F.max("source").alias("source"), F.max("offset").alias("offset"), F.max("text").alias("text"), one.alias("entities"))


def key_of(tokens: DataFrame) -> DataFrame:
    """The key of ``with_tokens``, as ``key_table`` gives it from entities."""
    rows = tokens.select("doc_id", "offset", F.explode_outer("entities").alias("e")).where("e is not null")
    at = F.struct((F.col("offset") + F.col("e.start")).alias("start"), (F.col("offset") + F.col("e.end")).alias("end"))
    value = rows.groupBy("doc_id", F.col("e.token").alias("placeholder"), F.col("e.entity_type").alias("entity_type"), F.col("e.text").alias("original_value")).agg(F.min(at).alias("first"), F.count("*").alias("occurrences"))
    same = F.count("*").over(Window.partitionBy("doc_id", "placeholder"))
    return value.select("doc_id", "placeholder", "entity_type", "original_value", "occurrences", F.col("first.start").alias("first_start"), F.col("first.end").alias("first_end"), (same > 1).alias("is_ambiguous"))


def anonymized_lines(tokens: DataFrame) -> DataFrame:
    """(doc_id, line_no, source, text) of ``with_tokens``: tokens in place of entities, per line, so
    that a line end in a cell moves nothing."""
    return tokens.select("doc_id", "line_no", "source", F.when(F.size("entities") == 0, F.col("text")).otherwise(S.splice(F.col("text"), F.col("entities"))).alias("text"))


def joined_text(lines: DataFrame) -> DataFrame:
    """(doc_id, text): a document's lines in order, joined by line ends."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def counts_by_type(key: DataFrame) -> DataFrame:
    """Distinct values per document and type."""
    return key.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n_values"))


def totals(key: DataFrame) -> DataFrame:
    """(doc_id, n_values): distinct values of all types per document."""
    return key.groupBy("doc_id").agg(F.count("*").alias("n_values"))


def chips(key: DataFrame) -> DataFrame:
    """(entity_type, n_values) over all documents, the most first."""
    return key.groupBy("entity_type").agg(F.count("*").alias("n_values")).orderBy(F.desc("n_values"), "entity_type")


def redaction_pairs(key: DataFrame) -> DataFrame:
    """(doc_id, original_value, token, first_start): one token per value whatever its type, that
    of the first occurrence."""
    first = F.struct("first_start", "first_end", "entity_type")
    return key.groupBy("doc_id", "original_value").agg(F.min_by("placeholder", first).alias("token"), F.min("first_start").alias("first_start"))


def reidentify(text: DataFrame, key: DataFrame) -> DataFrame:
    """(doc_id, text, n_refused): tokens replaced by the values of the key.

    Only bracketed placeholders that stand for one value are put back; masks that several values
    share are left and counted.
    """
    found = S.matches(F.col("text"), r"\[[A-Z][A-Z_]*_[0-9]+\]|XXX-XX-[0-9X]{4}|\*\*\*\*[0-9]{4}|\[ADDRESS_REDACTED\]")
    k = key.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_set(F.when(~F.col("is_ambiguous"), F.struct("placeholder", "original_value")))).alias("values"),
        F.sum(F.col("is_ambiguous").cast("long")).alias("n_refused"),
    )
    both = text.join(k, "doc_id", "left").withColumn("found", found)
    known = F.filter(F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.try_element_at("values", m["value"]).alias("token"))), lambda s: s["token"].isNotNull())
    out = F.when(F.col("values").isNull(), F.col("text")).otherwise(S.splice(F.col("text"), known))
    return both.select("doc_id", out.alias("text"), F.coalesce("n_refused", F.lit(0)).cast("long").alias("n_refused"))
