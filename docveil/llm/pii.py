"""Personal data by patterns, checksum validators and context words, in DataFrame functions only.

A pattern proposes spans; a validator (Luhn, mod-97, part ranges, digit counts) confirms or drops
them; a context word shortly before raises the score. Spans under the threshold go, except those
of the four base kinds, which need no context.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Characters before a span in which a context word counts, and what one adds to the score.
REACH, BOOST, THRESHOLD = 40, 0.35, 0.6


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _card_ok(v: Column, before: Column, after: Column) -> Column:
    d = _digits(v)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def _ip_ok(v: Column, before: Column, after: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def _phone_ok(v: Column, before: Column, after: Column) -> Column:
    return F.length(_digits(v)).between(9, 15)


def _iban_ok(v: Column, before: Column, after: Column) -> Column:
    s = F.replace(v, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    value = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97)
    return F.length(s).between(15, 34) & (rest == 1)


def _ssn_ok(v: Column, before: Column, after: Column) -> Column:
    area = F.substring(v, 1, 3)
    alone = ~F.right(before, F.lit(1)).rlike("[0-9-]") & ~after.rlike("^[0-9-]")
    return alone & (area < "900") & ~area.isin("000", "666") & (F.substring(v, 5, 2) != "00") & (F.substring(v, 8, 4) != "0000")


@dataclass(frozen=True)
class Kind:
    """``likely`` is a cheap test that text without a match mostly fails."""

    name: str
    pattern: str
    likely: Callable[[Column], Column]
    ok: Callable[[Column, Column, Column], Column] | None
    score: float
    context: tuple[str, ...] = field(default=())
    base: bool = True


#: Starts of e-mails: only where a run of their characters starts or the last match ended, which
#: are the leftmost ones; so a long run is read once. Possessive loops keep the matcher's stack flat.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), None, 0.9, ("mail", "contact")),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _ip_ok, 0.6, ("ip", "address", "host", "server")),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), _card_ok, 1.0, ("card", "visa", "credit")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"), _phone_ok, 0.6, ("phone", "call", "tel", "mobile")),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), _iban_ok, 1.0, ("iban", "account"), False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), _ssn_ok, 0.5, ("ssn", "social security", "soc sec"), False),
)


#: Matches that one inner fold takes; arrays grow by copying, so a fold of all would be quadratic.
CHUNK = 128
FOUND = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it may use often and that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    """``FOUND``: the leftmost non-overlapping matches, in code points, with the ``REACH`` characters
    before each and the one after it.

    Matches and the pieces between them are taken in turn, so nothing is looked up by its place
    in the text, which would read the text from its start each time.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("values"), F.split(text, pattern, -1).alias("gaps"))
    last = lambda c: F.right(c, F.lit(REACH))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["v"])
        said = lambda before: F.struct(
            end.alias("at"), last(F.concat(before, x["v"])).alias("tail"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"), before.alias("before"), F.left(x["n"], F.lit(1)).alias("after")))).alias("out"),
        )
        return _let(last(F.concat(acc["tail"], last(x["g"]))), said)

    state = lambda at, tail, kind: F.struct(at.alias("at"), tail.alias("tail"), F.array().cast(kind).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, state(acc["at"], acc["tail"], FOUND), step)
        return _let(inner, lambda r: F.struct(r["at"].alias("at"), r["tail"].alias("tail"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def placed(b: Column) -> Column:
        n = F.size(b["values"])
        steps = F.arrays_zip(F.slice(b["gaps"], 1, n).alias("g"), b["values"].alias("v"), F.slice(b["gaps"], 2, n).alias("n"))
        few = F.aggregate(steps, state(F.lit(0), F.lit(""), FOUND), step, lambda acc: acc["out"])
        parts = _let(steps, lambda s: F.transform(F.sequence(F.lit(1), F.size(s), F.lit(CHUNK)), lambda i: F.slice(s, i, CHUNK)))
        many = F.aggregate(parts, state(F.lit(0), F.lit(""), f"array<{FOUND}>"), chunk, lambda acc: F.flatten(acc["out"]))
        return F.when(n <= CHUNK, few).otherwise(many)

    return _let(both, placed)


def _spans(text: Column, kind: Kind) -> Column:
    found = _matches(text, kind.pattern)
    if kind.ok:
        found = F.filter(found, lambda x: kind.ok(x["value"], x["before"], x["after"]))
    near = lambda x: F.lower(x["before"]).rlike("|".join(kind.context))
    score = lambda x: F.least(F.lit(kind.score) + F.when(near(x), BOOST).otherwise(0.0), F.lit(1.0))
    out = F.transform(found, lambda x: F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("score")))
    if not kind.base:
        out = F.filter(out, lambda x: x["score"] >= THRESHOLD)
    return F.when(kind.likely(text), out).otherwise(F.array().cast(SPAN)).cast(SPAN)


def pii_spans(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """Spans (kind, start, end, score) of a text, by kind and then start; a null text has none.

    Offsets are code points, the end exclusive. Spans of one kind don't overlap; those of
    different kinds may.
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike("[0-9@]"), F.concat(*(_spans(t, k) for k in kinds))).otherwise(F.array().cast(SPAN))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind, such as ``[EMAIL]``.

    Of overlapping spans the one that starts first, then the longer one, gives the placeholder and
    all that any of them covers goes. A null text stays null.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.when(fresh, gap).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], -s["neg"]).alias("at"))

    whole = F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, spans) for each row of ``docs`` (doc_id, text); other columns are ignored.

    Null and empty texts have no spans; repeated rows each get their row.
    """
    return docs.select("doc_id", pii_spans(F.col("text"), kinds).alias("spans"))
