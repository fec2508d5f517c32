"""Lines to resolved entities: detect, validate, score by context, trim, resolve, place."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.functions import spans as S
from docveil.operators.registry import DETECTORS, DETERMINISTIC, Detector

THRESHOLD, BOOST, WINDOW = 0.35, 0.35, 5
#: The sort key of a choice (det, nscore, nlen, start, ordinal) and then the rest of an entity.
KIND = "struct<det:int,nscore:double,nlen:int,start:int,ordinal:int,end:int,entity_type:string,score:double,text:string>"


#: What a choice needs to know of a detector, by its ordinal.
KNOWN = "array<struct<det:int,score:double,entity:string,near:string>>"


def _near(words: tuple[str, ...]) -> str:
    """A pattern of context words on word boundaries; empty if there are none."""
    either = "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\#", "#") for w in words)
    return rf"(?:^|[^a-z0-9])(?:{either})(?:$|[^a-z0-9])" if words else ""


def _before(text: Column, start: Column) -> Column:
    """The ``WINDOW`` blank-separated tokens before a place in the line, in lower case."""
    tokens = F.filter(F.split(F.substring(text, F.lit(1), start), r"\s+"), lambda t: t != "")
    return F.lower(F.array_join(F.reverse(F.slice(F.reverse(tokens), 1, WINDOW)), " "))


def detected(text: Column, detectors: tuple[Detector, ...] = DETECTORS, threshold: float = THRESHOLD) -> Column:
    """An array of ``KIND``: all detectors' trimmed spans that reach the threshold.

    A detector gives only the values and the gaps of its pattern; the places, scores and trimming
    of all are one expression over these, so a plan grows little with the detectors.
    """
    kind = f"array<{KIND}>"
    if not detectors:
        return F.array().cast(kind)
    known = F.from_json(F.lit(json.dumps([{"det": 0 if d.deterministic else 1, "score": d.score, "entity": d.entity, "near": _near(d.context)} for d in detectors])), KNOWN)
    likely = {d.likely: text.contains(d.likely) if d.likely in ("@", "://") else text.rlike(d.likely) for d in detectors}
    raw = F.array_compact(F.array(*(
        F.when(likely[d.likely], F.struct(F.lit(i).alias("k"), F.regexp_extract_all(text, F.lit(d.pattern), 0).alias("values"), F.split(text, d.pattern, -1).alias("gaps"))) for i, d in enumerate(detectors)
    )))

    def valid(k: Column, value: Column) -> Column:
        """True, false, or null where there is no test."""
        tests: dict[Callable, list[int]] = {}
        for i, d in enumerate(detectors):
            if d.valid:
                tests.setdefault(d.valid, []).append(i)
        out = F.lit(None).cast("boolean")
        for test, of in tests.items():
            out = F.when(k.isin(of), test(value)).otherwise(out)
        return out

    def score(m: Column) -> Column:
        """1 if valid, null if not, else the base score with what context adds."""
        near = F.when(m["d"]["near"] != "", F.rlike(_before(text, m["start"]), m["d"]["near"]))
        base = F.least(m["d"]["score"] + F.when(near, BOOST).otherwise(0.0), F.lit(1.0))
        return F.when(m["ok"], 1.0).when(~m["ok"], F.lit(None)).otherwise(base)

    def entity(m: Column) -> Column:
        start, value = S.trimmed_start(m["value"], m["start"]), S.trimmed(m["value"])
        n = F.length(value)
        return F.struct(
            m["d"]["det"].alias("det"), (-m["score"]).alias("nscore"), (-n).alias("nlen"), start.alias("start"), m["k"].alias("ordinal"),
            (start + n).alias("end"), m["d"]["entity"].alias("entity_type"), m["score"].alias("score"), value.alias("text"),
        )

    def of(r: Column) -> Column:
        # What is used twice below is a field first, so that it is evaluated once.
        judged = F.transform(S.placed(r), lambda m: F.struct(r["k"].alias("k"), F.get(known, r["k"]).alias("d"), m["start"].alias("start"), m["value"].alias("value"), valid(r["k"], m["value"]).alias("ok")))
        scored = F.transform(judged, lambda m: F.struct(m["k"].alias("k"), m["d"].alias("d"), m["start"].alias("start"), m["value"].alias("value"), score(m).alias("score")))
        return F.filter(F.transform(F.filter(scored, lambda m: m["score"] >= threshold), entity), lambda e: e["nlen"] < 0)

    return F.flatten(F.transform(F.filter(raw, lambda r: F.size(r["values"]) > 0), of)).cast(kind)


def entities_of(text: Column, detectors: tuple[Detector, ...] = DETECTORS, threshold: float = THRESHOLD, extra: Column | None = None) -> Column:
    """The resolved entities of a line. ``extra`` (an array of ``KIND``) joins before the choice."""
    found = detected(text, detectors, threshold)
    return S.resolve(found if extra is None else F.concat(found, extra), f"array<{KIND}>")


def with_entities(lines: DataFrame, detectors: tuple[Detector, ...] = DETECTORS, threshold: float = THRESHOLD) -> DataFrame:
    """``lines`` with an array column ``entities``; narrow, so it runs on streams too.

    A column ``extra`` (an array of ``KIND``) holds spans from elsewhere that join the choice.
    """
    extra = F.col("extra") if "extra" in lines.columns else None
    few = F.col("text").rlike("[0-9@]|://")
    none = F.array().cast(f"array<{KIND}>") if extra is None else S.resolve(extra, f"array<{KIND}>")
    return lines.withColumn("entities", F.when(few, entities_of(F.col("text"), detectors, threshold, extra)).otherwise(none))


def with_offsets(lines: DataFrame) -> DataFrame:
    """``lines`` with ``offset``: where a line starts in its document's lines joined by ``\\n``."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("text").cast("long") + 1).over(before), F.lit(0)).cast("long"))


def entities(found: DataFrame) -> DataFrame:
    """A row per entity of ``found`` (doc_id, line_no, text, source, offset, entities).

    start and end are places in the document, line_start and line_end in the line.
    """
    # explode would also filter on the array's size below, that is, detect twice.
    rows = found.select("doc_id", "line_no", "source", "offset", F.explode_outer("entities").alias("e")).where("e is not null")
    return rows.select(
        "doc_id", "line_no", F.col("e.entity_type").alias("entity_type"), (F.col("offset") + F.col("e.start")).alias("start"), (F.col("offset") + F.col("e.end")).alias("end"),
        F.col("e.start").alias("line_start"), F.col("e.end").alias("line_end"), F.col("e.score").alias("score"), F.col("e.text").alias("text"), "source",
    )


def analyze(lines: DataFrame, detectors: tuple[Detector, ...] = DETECTORS, threshold: float = THRESHOLD) -> DataFrame:
    """Lines (doc_id, line_no, text, source) to entities; one shuffle, by document."""
    return entities(with_entities(with_offsets(lines), detectors, threshold))


#: What a listed term and a line's words are cut into.
WORD = r"[\p{L}\p{N}&#.'-]+"
#: Bytes of listed terms, with ``ROW_BYTES`` a term, up to which all are broadcast.
BROADCAST_BYTES, ROW_BYTES = 4 << 20, 64


def dictionary(lines: DataFrame, terms: DataFrame, entity: str, score: float = 0.85) -> DataFrame:
    """Whole-word, case-sensitive occurrences of listed terms (term), a row per occurrence.

    A stand-in for a trained recogniser of names: terms that are not listed are missed. The
    n-grams of a line's words that are as many as some term's are joined with the terms, which are
    measured first: Spark's guess, by the size of compressed files, may broadcast a long list.
    """
    terms = terms.select("term").where("term is not null").distinct()
    known = terms.agg(F.collect_set(F.size(S.matches(F.col("term"), WORD))).alias("sizes"), F.sum(F.octet_length("term") + ROW_BYTES).alias("bytes")).first()
    sizes = sorted(n for n in known.sizes if n)
    counts = F.array(*(F.lit(n) for n in sizes)) if sizes else F.array().cast("array<int>")
    tokens = S.matches(F.col("text"), WORD)

    def grams(ts: Column) -> Column:
        fits = lambda i: F.filter(counts, lambda n: n <= F.size(ts) - i)
        return F.flatten(F.transform(ts, lambda t, i: F.transform(fits(i), lambda n: F.struct(t["start"].alias("start"), F.get(ts, i + n - 1)["end"].alias("end")))))

    rows = lines.select("doc_id", "line_no", "text", F.explode(S.let(tokens, grams)).alias("g"))
    raw = F.expr("substring(text, g.start + 1, g.end - g.start)")
    rows = rows.select("doc_id", "line_no", S.trimmed_start(raw, F.col("g.start")).alias("line_start"), S.trimmed(raw).alias("term"))
    found = rows.join(terms.hint("broadcast" if (known.bytes or 0) <= BROADCAST_BYTES else "merge"), "term").distinct()
    return found.select("doc_id", "line_no", F.lit(entity).alias("entity_type"), "line_start", (F.col("line_start") + F.length("term")).alias("line_end"), F.lit(score).alias("score"), F.col("term").alias("text"))


def is_deterministic(entity_type: str) -> bool:
    return entity_type in DETERMINISTIC
