"""URL filter: host-suffix and path-prefix expressions joined on short hash prefixes.

A rule is a host and a path prefix. Of a URL's host suffixes and path prefixes only those of a
shape (labels of the host, length of the path) that some rule has are formed, so a URL gives as
many expressions as the rules have shapes and every rule that fits is among them. Expressions
meet rules on the first 4 bytes of their SHA-256 digest; the full digests then decide, and of the
rules that fit the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.llm.common import ascii_lower, written

#: Bytes of rules that may be broadcast; more are joined with salt.
BROADCAST_BYTES = 20_000_000
SALTS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, between the first ``://`` and ``/``, ``?``, ``#`` or the end, and
    the path up to ``?``, ``#`` or the end; both empty if the URL is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    kept = F.get(F.split(rest, "[?#]", 2), F.lit(0))
    slash = F.instr(kept, "/")
    host = F.when(slash > 0, F.substring(kept, F.lit(1), slash - 1)).otherwise(kept)
    path = F.when(slash > 0, F.substring(kept, slash, F.length(kept))).otherwise(F.lit(""))
    return ascii_lower(host), path


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _expression(host: Column, path: Column) -> Column:
    """Host and path as one text; a host holds no question mark, so it tells where the path starts."""
    return F.concat(host, F.lit("?"), path)


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url).

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the URL's
    path starts with the rule's. The longest rule wins: host and path together, then the longer
    host, then the verdict that sorts last (block before allow). Without a rule that fits, the
    rule is null and the verdict ``default``. Rules with a null host, path or verdict fit
    nothing; repeated rules count once; repeated pages each get their row. Other columns are
    ignored. Without rules every verdict is ``default``.
    """
    rules = rules.select(ascii_lower(F.col("host")).alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv")).where("rh is not null and rp is not null and rv is not null")
    rules = rules.groupBy("rh", "rp").agg(F.max("rv").alias("rv"))
    # A list of shapes, not of rules: as many as there are counts of labels times lengths of paths.
    shapes = rules.select(_labels(F.col("rh")).alias("n"), F.length("rp").alias("p")).distinct().orderBy("n", "p").toJSON().collect()
    digest = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    rules = rules.select(F.concat("rh", "rp").alias("rule"), "rv", F.length("rh").alias("hl"), digest(_expression(F.col("rh"), F.col("rp"))).alias("full"))
    short = lambda c: F.substring(c, 1, 4)
    rules = written(rules.withColumn("short", short(F.col("full"))), "rules")

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path"))
    n, parts = _labels(F.col("host")), F.split("host", r"\.")
    fitting = F.filter(F.from_json(F.lit(f"[{','.join(shapes)}]"), "array<struct<n:int,p:int>>"), lambda s: (s["n"] <= n) & (s["p"] <= F.length("path")))
    expressions = F.transform(fitting, lambda s: _expression(F.array_join(F.slice(parts, n - s["n"] + 1, s["n"]), "."), F.substring(F.col("path"), F.lit(1), s["p"])))
    rows = rows.withColumn("e", F.explode_outer(expressions)).withColumn("d", digest(F.col("e"))).withColumn("p", short(F.col("d")))
    size = rules.select(F.coalesce(F.sum(F.octet_length("rule") + 100), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(rules), F.col("p") == F.col("short"), "left")
    else:
        # A host may hold a third of all pages: its expressions are dealt over the salts.
        rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("s", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        own = F.coalesce("p", F.col("row").cast("string").cast("binary"))
        joined = rows.withColumn("p", own).join(rules, (F.col("p") == F.col("short")) & (F.col("s") == F.col("salt")), "left")
    fits = F.when(F.col("d") == F.col("full"), F.struct(F.length("rule").alias("len"), "hl", "rv", "rule"))
    best = joined.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(fits).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rv", F.lit(default)).alias("verdict"))
