"""Spans of a text as arrays of structs: matches, trimming, overlaps, splicing.

Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what is trimmed from the edges of a span.
EDGE = " \t\r\n.,;:!?\"'`()[]{}<>|"
MATCH = "array<struct<start:int,end:int,value:string>>"


#: Matches that one inner fold takes; arrays grow by copying, so a fold of all would be quadratic.
CHUNK = 128


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it may use often and that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches (start, end, value) of a pattern without groups that capture.

    Lengths of the pieces between matches and of the matches add up to the offsets.
    """
    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("values"), F.split(text, pattern, -1).alias("gaps")), placed)


def placed(b: Column) -> Column:
    """Matches from a struct of their ``values`` and of the ``gaps`` around them."""
    one = F.array().cast(MATCH)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["v"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value")))).alias("out"))

    def chunk(acc: Column, i: Column) -> Column:
        part = F.slice(F.arrays_zip(b["gaps"].alias("g"), b["values"].alias("v")), i, F.least(F.lit(CHUNK), F.size(b["values"]) - i + 1))
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), one.alias("out")), step)
        return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{MATCH}>").alias("out"))
    chunks = F.sequence(F.lit(1), F.size(b["values"]), F.lit(CHUNK))
    return F.when(F.size(b["values"]) > 0, F.aggregate(chunks, none, chunk, lambda acc: F.flatten(acc["out"]))).otherwise(one)


def trimmed_start(value: Column, start: Column) -> Column:
    return start + F.length(value) - F.length(F.ltrim(value, F.lit(EDGE)))


def trimmed(value: Column) -> Column:
    return F.trim(value, F.lit(EDGE))


def resolve(spans: Column, kind: str) -> Column:
    """The spans that a greedy choice keeps, in order of start.

    ``spans`` is of the type ``kind``, whose fields start with the sort key (smaller wins) and
    include start and end; a span that overlaps a chosen one goes.
    """
    none = F.array().cast(kind)
    clash = lambda acc, s: F.exists(acc, lambda c: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    chosen = F.aggregate(F.array_sort(spans), none, lambda acc, s: F.when(clash(acc, s), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(chosen, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def splice(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, token) replaced, from right to left.

    Of overlapping spans the later-starting one, of equal starts the shorter, is applied.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct((-s["start"]).alias("neg"), s["end"].alias("end"), s["token"].alias("token"))))
    start = F.struct(F.lit("").alias("out"), F.length(text).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        out = F.concat(s["token"], F.substring(text, s["end"] + 1, acc["at"] - s["end"]), acc["out"])
        ok = s["end"] <= acc["at"]
        return F.struct(F.when(ok, out).otherwise(acc["out"]).alias("out"), F.when(ok, -s["neg"]).otherwise(acc["at"]).alias("at"))

    return F.aggregate(order, start, step, lambda acc: F.concat(F.substring(text, F.lit(1), acc["at"]), acc["out"]))
