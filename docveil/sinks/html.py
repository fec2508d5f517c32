"""Text as HTML with entities or tokens marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Background colours by type.
COLOURS = {
    "PERSON": "#ffd6a5", "LOCATION": "#caffbf", "ORG": "#bdb2ff", "US_SSN": "#ffadad", "US_EIN": "#ffc6ff",
    "US_BANK_ROUTING": "#9bf6ff", "CREDIT_CARD": "#fdffb6", "EMAIL_ADDRESS": "#a0c4ff", "PHONE_NUMBER": "#d0f4de",
}
OTHER = "#e0e0e0"


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def label(entity_type: Column) -> Column:
    """``US_BANK_ROUTING`` to ``Bank Routing``."""
    return F.initcap(F.replace(F.regexp_replace(entity_type, "^US_", ""), F.lit("_"), F.lit(" ")))


def highlighted(text: Column, spans: Column) -> Column:
    """The text, escaped, with each span (start, end, entity_type, score) in a ``mark``; of
    overlapping spans the one that starts first stays."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), s["score"].alias("score"))))
    colours = F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv))
    none = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(
            F.lit('<mark style="background:'), F.coalesce(F.try_element_at(colours, s["entity_type"]), F.lit(OTHER)), F.lit('" title="'), label(s["entity_type"]),
            F.format_string(" %.2f", s["score"]), F.lit('">'), escaped(F.substring(text, s["start"] + 1, s["end"] - s["start"])), F.lit("</mark>"),
        )
        ok = s["start"] >= acc["at"]
        return F.struct(F.when(ok, F.concat(acc["out"], escaped(gap), mark)).otherwise(acc["out"]).alias("out"), F.when(ok, s["end"]).otherwise(acc["at"]).alias("at"))

    return F.aggregate(order, none, step, lambda acc: F.concat(acc["out"], escaped(F.substring(text, acc["at"] + 1, F.length(text)))))


def rendered(text: Column) -> Column:
    """Rewritten text, escaped, with placeholders and masks in a ``mark``."""
    return F.regexp_replace(escaped(text), r"(\[?[A-Z][A-Z_]*_\d+\]?|XXX-XX-[0-9X]{4}|\*{4}(?:\d{4})?|\[ADDRESS_REDACTED\])", "<mark>$1</mark>")


def highlighted_lines(found: DataFrame) -> DataFrame:
    """(doc_id, line_no, html) of ``found`` (doc_id, line_no, text, entities)."""
    return found.select("doc_id", "line_no", highlighted(F.col("text"), F.col("entities")).alias("html"))
