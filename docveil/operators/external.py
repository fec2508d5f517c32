"""Detectors from outside the registry: a trained recogniser, or listed terms."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docveil.operators.detect import KIND, THRESHOLD, is_deterministic

#: A recogniser: the (entity type, start, end, score) that it finds in a text.
Recognizer = Callable[[str], Iterable[tuple[str, int, int, float]]]
#: Ordinals of spans from outside come after the registry's.
LAST = 1000


def recognized(lines: DataFrame, load: Callable[[], Recognizer], threshold: float = THRESHOLD) -> DataFrame:
    """``lines`` (doc_id, line_no, text, ...) with ``extra``, what a recogniser finds in each line.

    ``load`` makes the recogniser once in a task, where a model is read. Spans under the
    threshold, outside the line or of edge characters only are dropped. A null text has none.
    """
    from docveil.functions.spans import EDGE

    lines = lines.drop("extra")
    schema = T.StructType([*lines.schema.fields, T.StructField("extra", T.ArrayType(T._parse_datatype_string(KIND)))])

    def spans(find: Recognizer, text: str | None) -> list[dict]:
        out = []
        for k, (kind, start, end, score) in enumerate(find(text) if text else ()):
            if score < threshold or not 0 <= start < end <= len(text):
                continue
            start += len(text[start:end]) - len(text[start:end].lstrip(EDGE))
            value = text[start:end].strip(EDGE)
            if value:
                det = 0 if is_deterministic(kind) else 1
                out.append({"det": det, "nscore": -float(score), "nlen": -len(value), "start": start, "ordinal": LAST + k, "end": start + len(value), "entity_type": kind, "score": float(score), "text": value})
        return out

    def run(it):
        find = load()
        for b in it:
            yield b.assign(extra=pd.Series([spans(find, t) for t in b["text"]], index=b.index, dtype=object))

    return lines.mapInPandas(run, schema)


def with_listed(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``lines`` with ``extra`` from rows of ``found`` (doc_id, line_no, entity_type, line_start,
    line_end, score, text), such as ``detect.dictionary`` gives."""
    n = F.length("text")
    one = F.struct(
        F.lit(1).alias("det"), (-F.col("score")).alias("nscore"), (-n).alias("nlen"), F.col("line_start").alias("start"), F.lit(LAST).alias("ordinal"),
        F.col("line_end").alias("end"), "entity_type", "score", "text",
    )
    of = found.groupBy("doc_id", "line_no").agg(F.collect_list(one).cast(f"array<{KIND}>").alias("extra"))
    return lines.drop("extra").join(of, ["doc_id", "line_no"], "left").withColumn("extra", F.coalesce("extra", F.array().cast(f"array<{KIND}>")))
