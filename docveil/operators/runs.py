"""Values as runs of a page's words, for redaction by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.functions.spans import trimmed

LINE = ["doc_id", "page", "block", "line"]


def folded(v: Column) -> Column:
    return F.lower(F.regexp_replace(v, r"\s+", ""))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def is_numeric(v: Column) -> Column:
    """More than half of what isn't blank is digits."""
    core = F.regexp_replace(v, r"\s+", "")
    return (F.length(core) > 0) & (F.length(digits(core)) * 2 > F.length(core))


def targets(values: DataFrame) -> DataFrame:
    """``values`` (doc_id, value) with numeric and key; values without a key are dropped."""
    n = is_numeric(F.col("value"))
    return values.select("doc_id", "value", n.alias("numeric"), F.when(n, digits(F.col("value"))).otherwise(folded(F.col("value"))).alias("key")).where("key <> ''")


def _keys(pieces: Column, sizes: Column) -> Column:
    """The runs (i, j, key) of neighbouring pieces, none of them empty, whose key has one of ``sizes``."""
    one = "array<struct<i:int,j:int,key:string>>"
    longest = F.coalesce(F.array_max(sizes), F.lit(0))

    def runs_from(i: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            key = F.concat(acc["key"], x)
            open_ = acc["open"] & (x != "") & (F.length(key) <= longest)
            fits = open_ & F.array_contains(sizes, F.length(key))
            out = F.when(fits, F.concat(acc["out"], F.array(F.struct(i.alias("i"), acc["j"].alias("j"), key.alias("key"))))).otherwise(acc["out"])
            return F.struct(F.when(open_, key).otherwise(acc["key"]).alias("key"), (acc["j"] + 1).alias("j"), open_.alias("open"), out.alias("out"))

        start = F.struct(F.lit("").alias("key"), i.alias("j"), F.lit(True).alias("open"), F.array().cast(one).alias("out"))
        return F.aggregate(F.slice(pieces, i + 1, longest), start, step, lambda acc: acc["out"])

    every = F.transform(pieces, lambda x, i: F.when(x != "", runs_from(i)).otherwise(F.array().cast(one)))
    return F.when(longest > 0, F.flatten(every)).otherwise(F.array().cast(one))


def find_runs(words: DataFrame, values: DataFrame, trim_edges: bool = True) -> DataFrame:
    """(doc_id, page, block, line, value, first_word, last_word, x0, y0, x1, y1) of each run of
    neighbouring words of a line whose joined text equals a value's key.

    Runs of one value are leftmost and don't overlap. A word without a digit (for numeric values)
    or text breaks a run. With ``trim_edges`` punctuation at the edges of a text's words is not
    part of it, so ``Chen,`` matches ``Chen``. Within a line only runs as long as some key of the
    document are formed; they meet the keys by an equi-join and carry the places of two words.
    """
    t = targets(values).distinct()
    sizes = lambda numeric: F.collect_set(F.when(F.col("numeric") == numeric, F.length("key")))
    wanted = t.groupBy("doc_id").agg(sizes(True).alias("digit_sizes"), sizes(False).alias("text_sizes"))
    word = F.struct("word_no", "x0", "y0", "x1", "y1", "text")
    lines = words.groupBy(*LINE).agg(F.array_sort(F.collect_list(word)).alias("w")).join(wanted, "doc_id")
    text = lambda x: folded(trimmed(x["text"]) if trim_edges else x["text"])
    kinds = ((True, lambda x: digits(x["text"]), "digit_sizes"), (False, text, "text_sizes"))
    tag = lambda found, numeric: F.transform(found, lambda r: F.struct(F.lit(numeric).alias("numeric"), r["i"].alias("i"), r["j"].alias("j"), r["key"].alias("key")))
    both = F.concat(*(tag(_keys(F.transform("w", piece), F.col(size)), numeric) for numeric, piece, size in kinds))
    place = lambda at, name: F.get("w", at)[name]
    struct = lambda r: F.struct(
        r["numeric"].alias("numeric"), r["key"].alias("key"), r["i"].alias("i"), r["j"].alias("j"), place(r["i"], "word_no").alias("first_word"), place(r["j"], "word_no").alias("last_word"),
        place(r["i"], "x0").alias("x0"), place(r["i"], "y0").alias("y0"), place(r["j"], "x1").alias("x1"), place(r["j"], "y1").alias("y1"),
    )
    # explode would also filter on the array's size below, that is, form the runs twice.
    found = lines.select(*LINE, F.explode_outer(F.transform(both, struct)).alias("r")).where("r is not null").select(*LINE, "r.*")
    hit = found.join(t, ["doc_id", "numeric", "key"])
    run = F.struct("i", "j", "first_word", "last_word", "x0", "y0", "x1", "y1")
    of = hit.groupBy(*LINE, "value").agg(F.array_sort(F.collect_list(run)).alias("runs"), F.first(run).alias("one"))
    none = F.slice(F.array("one"), 1, 0)
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["j"], F.lit(-1))
    chosen = F.aggregate("runs", none, lambda acc, r: F.when(r["i"] > last(acc), F.concat(acc, F.array(r))).otherwise(acc))
    out = of.select(*LINE, "value", F.explode(chosen).alias("r"))
    return out.select(*LINE, "value", *(f"r.{c}" for c in ("first_word", "last_word", "x0", "y0", "x1", "y1")))


def match_counts(values: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, value, n_runs) of each distinct value, 0 where no run shows it."""
    n = runs.groupBy("doc_id", "value").agg(F.count("*").alias("n_runs"))
    return values.select("doc_id", "value").distinct().join(n, ["doc_id", "value"], "left").select("doc_id", "value", F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"))


def unlocated(values: DataFrame, runs: DataFrame) -> DataFrame:
    """Values (doc_id, value) that no run shows, which would stay readable."""
    return values.select("doc_id", "value").distinct().join(runs.select("doc_id", "value").distinct(), ["doc_id", "value"], "left_anti")
