"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's k-gram hashes are winnowed: of each window of w successive k-grams the least hash is
kept. A span of k + w - 1 words that a document shares with a benchmark item is one whole window
in both, so it has the same least hash in both; no shared span of that many words is missed. A
document's windows whose kept hash is among the benchmark's are extended to their words and
joined with the benchmark's windows on these words' SHA-256, so that no collision of the short
hashes decides anything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.llm.common import ascii_lower, written

#: What is between words: ASCII without digits and letters, as these texts are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark hashes that may be in the plan as a set; more are there as a bitmap of at most ``BITS``
#: (2 MB), whose false hits the join on the windows' words drops.
IN_PLAN, BITS = 20_000, 1 << 24
#: Rows of 48 bytes, such as distinct benchmark windows, that may be broadcast.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; null has none."""
    return _inner(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN))


def _inner(parts: Column) -> Column:
    """Without the empty strings that a split leaves before a first and after a last separator."""
    first, last = (F.get(parts, F.lit(0)) == "").cast("int"), (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def _gram(h: Column, i: Column, k: int) -> Column:
    """The hash of the k-gram at ``i`` from the words' hashes ``h``."""
    return F.xxhash64(*(F.get(h, i + j) for j in range(k)))


def _least(h: Column, i: Column, k: int, w: int) -> Column:
    """What winnowing keeps of the window of ``w`` k-grams from ``i``."""
    return F.least(*(_gram(h, i + j, k) for j in range(w))) if w > 1 else _gram(h, i, k)


def _upto(last: Column) -> Column:
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _lookup(windows: DataFrame) -> Callable[[Column], Column]:
    """A test whether a hash is among the windows' kept ones, exact or by a bitmap."""
    kept = [r[0] for r in windows.select("kept").distinct().limit(IN_PLAN + 1).collect()]
    if len(kept) <= IN_PLAN:
        return lambda h: h.isin(kept)
    n = windows.select("kept").distinct().count()
    bits = min(BITS, max(64, 1 << (16 * n).bit_length()))
    place = F.pmod("kept", F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = windows.groupBy(F.expr(f"pmod(kept, {bits}) div 64").alias("w")).agg(F.bit_or(bit).alias("b")).collect()
    table = [0] * (bits // 64)
    for r in words:
        table[r["w"]] = r["b"]
    literal = F.from_json(F.lit(f"[{','.join(map(str, table))}]"), "array<bigint>")
    at = lambda h: F.pmod(h, F.lit(bits))
    return lambda h: F.call_function("bit_get", F.get(literal, F.floor(at(h) / 64).cast("int")), (at(h) % 64).cast("int")) == 1


def _starts(h: Column, k: int, w: int, listed: Callable[[Column], Column]) -> Column:
    """Starts of the windows whose kept hash is ``listed``.

    Few grams are, so these are looked up first and only the windows around one are asked whether
    it is their least.
    """
    last = F.size(h) - (k + w - 1)
    at = F.filter(_upto(F.size(h) - k), lambda i: listed(_gram(h, i, k)))
    if w == 1:
        return at
    near = lambda i: F.when(F.least(i, last) >= F.greatest(i - (w - 1), F.lit(0)), F.sequence(F.greatest(i - (w - 1), F.lit(0)), F.least(i, last))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.filter(near(i), lambda s: _least(h, s, k, w) == _gram(h, i, k)))))


@dataclass(frozen=True)
class Contamination:
    """``documents`` (doc_id, n_words, n_hit, hits, item_set) and ``item_sets`` (item_set, items).

    Documents that the same items hit share an ``item_set``, whose list of items is there once,
    however many documents and items share a passage; it is null for a document without hits.
    """

    documents: DataFrame
    item_sets: DataFrame


def _digest(window: Column) -> Column:
    """What stands for a window's words: 32 bytes, however long the words are."""
    return F.unhex(F.sha2(window.cast("binary"), 256))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10, k: int = 5) -> Contamination:
    """``documents`` has a row per row of ``docs``, ``item_sets`` the sorted items (as strings) that
    hit some document.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. A
    window is ``length`` successive words of an item, or all words of a shorter one. ``hits`` are
    the positions (from 0) of the words that any occurrence of a window covers. Null and empty
    texts have no words and no hits; items without words, and null item ids, match nothing.
    Repeated rows each get their row. An empty benchmark leaves all documents clean.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("item is not null and size(w) > 0")
    items = written(items, "items")
    lengths = sorted(r[0] for r in items.select(F.least(F.size("w"), F.lit(length))).distinct().collect())
    grams = {n: (min(k, n), n - min(k, n) + 1) for n in lengths}  # words of a window: k, w
    hashed = items.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    parts = [
        hashed.where(F.size("w") >= n if n == length else F.size("w") == n)
        .select("item", "w", "h", F.explode(_upto(F.size("w") - n)).alias("i"))
        .select("item", _digest(F.array_join(F.slice("w", F.col("i") + 1, n), " ")).alias("window"), _least(F.col("h"), F.col("i"), *grams[n]).alias("kept"))
        for n in lengths
    ]
    if not parts:
        none = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<int>").alias("hits"), F.lit(None).cast("long").alias("item_set"))
        return Contamination(none, docs.sparkSession.createDataFrame([], "item_set long, items array<string>"))
    windows = parts[0]
    for part in parts[1:]:
        windows = windows.unionByName(part)
    windows = written(windows.distinct(), "windows")
    listed = _lookup(windows)
    # Windows of the same items are a class: a passage that many items share has one list of them.
    of = written(windows.groupBy("kept", "window").agg(F.sort_array(F.collect_set("item")).alias("items")), "of")
    classes = written(of.select("items").distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    of = written(of.join(classes, "items").select("kept", "window", "class"), "class_of")

    row = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    row = row.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))

    def found(n: int) -> Column:
        at = _starts(F.col("h"), *grams[n], listed)
        window = lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), _least(F.col("h"), i, *grams[n]).alias("kept"), _digest(F.array_join(F.slice("w", i + 1, n), " ")).alias("window"))
        return F.transform(at, window)

    row = row.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.concat(*(found(n) for n in lengths)).alias("x"))
    row = row.select("row", "doc_id", "n_words", F.explode_outer("x").alias("x"))
    # A row without a candidate keeps a key of its own, so that no key gathers them all.
    none = F.col("row").cast("string").cast("binary")
    row = row.select("row", "doc_id", "n_words", F.col("x.start").alias("start"), F.col("x.len").alias("len"), F.coalesce("x.kept", "row").alias("kept"), F.coalesce("x.window", none).alias("window"))
    small = of.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hit = row.join(F.broadcast(of) if small else of, ["kept", "window"], "left")
    hit = hit.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("class").isNotNull(), F.struct("start", "len"))).alias("spans"),
        F.sort_array(F.collect_set("class")).alias("classes"),
    )
    at = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    # Two sets of classes with one number would need a collision of 64 bits among the sets that occur.
    number = F.when(F.size("classes") > 0, F.xxhash64("classes"))
    hit = written(hit.select("doc_id", "n_words", F.sort_array(at).alias("hits"), "classes", number.alias("item_set")), "hit")
    sets = hit.where("item_set is not null").groupBy("item_set").agg(F.first("classes").alias("classes"))
    sets = sets.select("item_set", F.explode("classes").alias("class")).join(classes, "class")
    sets = sets.groupBy("item_set").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return Contamination(hit.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), "hits", "item_set"), sets)


def with_items(found: Contamination, columns: dict[str, Column]) -> DataFrame:
    """``documents`` with ``columns`` of its set's ``items``; a document without hits has those of
    an empty list.

    The columns are computed once per set, and should be short: they are sent to all documents if
    the sets are few, else joined.
    """
    sets = written(found.item_sets.select("item_set", *(c.alias(n) for n, c in columns.items())), "sets")
    few = sets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hit = found.documents.where("item_set is not null").join(F.broadcast(sets) if few else sets, "item_set", "left")
    clean = found.documents.where("item_set is null").withColumn("items", F.array().cast("array<string>"))
    return hit.select(*found.documents.columns, *columns).unionByName(clean.select(*found.documents.columns, *(c.alias(n) for n, c in columns.items())))
