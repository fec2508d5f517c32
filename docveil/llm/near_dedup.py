"""MinHash near-duplicates with sequential Bayesian verification (BayesLSH).

Texts with equal shingle sets form one class and only classes are compared. Banded MinHash
proposes pairs of classes; their signatures are compared in batches and a pair is dropped as soon
as the posterior probability that its similarity reaches the threshold falls below ``miss``; the
pairs that stay are verified on the full shingle sets.

Within a bucket of a band no pairs among all members are formed at first: each is compared with
the bucket's smallest member. Only members of a bucket that are then in different components are
compared with each other, since a link inside a component changes no component. Of these, a
shingle that no other of them has can be in no intersection; the number of such shingles bounds a
document's similarity to any other, which clears groups of many copies just below the threshold.
What is left is compared in blocks of a bucket with longer signatures, and only survivors leave
the task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.llm.common import batches, written
from docveil.llm.components import components
from docveil.llm.shingles import mix, shingle_set, text_bytes

#: Rows of (node, doc_id, text hash) that may be broadcast: 24 MB.
BROADCAST_ROWS = 1_000_000
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024


@dataclass(frozen=True)
class NearDedup:
    """Five-word shingles and a similarity of 0.75; at 0.75 the bands miss a pair with 5e-6."""

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    batch: int = 32
    wide: int = 1024
    miss: float = 1e-7
    seed: int = 1

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def functions(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers and addends of the first ``size`` hash functions."""
        mul, add = (np.random.default_rng((self.seed, i)).integers(1, 2**63, size, dtype=np.uint64) for i in (0, 1))
        return mul * np.uint64(2) + np.uint64(1), add

    def folding(self) -> Callable[[np.ndarray], np.ndarray]:
        """The hash of each band, from the MinHashes of a text."""
        fold = np.random.default_rng(self.seed).integers(1, 2**63, self.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = mix(np.arange(1, self.bands + 1, dtype=np.uint64))
        return lambda least: mix((least.reshape(self.bands, self.rows) * fold).sum(axis=1) ^ salt).view(np.int64)

    def least_matches(self, hashes: int) -> list[tuple[int, int]]:
        """(m, n): after m of the 8-bit hashes, a pair with fewer than n equal ones is dropped.

        With a uniform prior of the chance p that two hashes agree, which is s + (1 - s) / 256 at
        similarity s, P(p >= p0 | n of m) is a binomial tail.
        """
        p0 = self.percent / 100 + (1 - self.percent / 100) / 256
        out = []
        for m in range(self.batch, hashes + 1, self.batch):
            tail, n = 0.0, 0
            for n in range(m + 1):
                tail += comb(m + 1, n) * p0**n * (1 - p0) ** (m + 1 - n)
                if tail >= self.miss:
                    break
            out.append((m, n))
        return out


def _least(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The MinHash of a shingle set for each function."""
    least = np.full(len(mul), 2**64 - 1, np.uint64)
    step = max(1, (1 << 17) // len(mul))
    for i in range(0, len(s), step):
        x = mul[:, None] * s[None, i : i + step]
        x += add[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    return mix(least)


def signatures(docs: DataFrame, p: NearDedup) -> DataFrame:
    """(doc_id, th, n, f1, f2, bands, sig): th hashes the text, f1 and f2 the whole shingle set.

    ``bands`` holds a hash for each band and ``sig`` the low byte of each MinHash; both are null
    for a text without words.
    """
    schema = "doc_id long, th long, n long, f1 long, f2 long, bands array<long>, sig binary"
    mul, add = p.functions(p.hashes)
    bands_of = p.folding()
    two = np.random.default_rng((p.seed, 2)).integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(it):
        typ = pa.struct([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
        for b in batches(it):
            n, f1, f2, bands, sig = [], [], [], [], []
            for data in text_bytes(b.column(2)):
                s = shingle_set(data, p.words)
                n.append(len(s))
                if not len(s):
                    f1.append(0), f2.append(0), bands.append(None), sig.append(None)
                    continue
                least = _least(s, mul, add)
                bands.append(bands_of(least))
                sig.append((least >> np.uint64(56)).astype(np.uint8).tobytes())
                f = [int(mix(s * t).sum()) & (2**64 - 1) for t in two]
                f1.append(f[0] - (f[0] >> 63 << 64)), f2.append(f[1] - (f[1] >> 63 << 64))
            cols = [b.column(0).cast(pa.int64()), b.column(1), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(list(typ)))

    text = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return text.mapInArrow(sign, schema)


def _alike(pairs: DataFrame, sigs: DataFrame, p: NearDedup) -> DataFrame:
    """Pairs (a, b, da, db, tha, thb) that the sequential comparison of signatures leaves."""
    a = sigs.select(F.col("node").alias("a"), F.col("doc_id").alias("da"), F.col("th").alias("tha"), F.col("sig").alias("sa"))
    b = sigs.select(F.col("node").alias("b"), F.col("doc_id").alias("db"), F.col("th").alias("thb"), F.col("sig").alias("sb"))
    steps = p.least_matches(p.hashes)

    def compare(it):
        for x in it:
            n = x.num_rows
            if not n:
                continue
            u, v = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in (6, 7))
            alive, seen, at = np.arange(n), np.zeros(n, np.int64), 0
            for m, least in steps:
                seen[alive] += (u[alive, at:m] == v[alive, at:m]).sum(axis=1)
                alive, at = alive[seen[alive] >= least], m
            yield pa.RecordBatch.from_arrays(list(x.columns[:6]), names=["a", "b", "da", "db", "tha", "thb"]).take(pa.array(alive))

    both = pairs.join(a, "a").join(b, "b").select("a", "b", "da", "db", "tha", "thb", "sa", "sb")
    return both.mapInArrow(compare, "a long, b long, da long, db long, tha long, thb long")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the distinct ``nodes`` (node, doc_id, th).

    Up to ``BROADCAST_ROWS`` of them, three numbers each, are sent to the scan; more are joined.
    """
    nodes = written(nodes.distinct(), "nodes")
    text = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    small = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return text.join(F.broadcast(nodes) if small else nodes, ["doc_id", "th"]).select("node", "text")


def _links(alike: DataFrame, docs: DataFrame, p: NearDedup) -> DataFrame:
    """Of ``alike``, the pairs (a, b) whose full shingle sets reach the threshold."""
    nodes = alike.selectExpr("a node", "da doc_id", "tha th").unionByName(alike.selectExpr("b node", "db doc_id", "thb th"))
    return _verified(alike.select("a", "b"), _texts(docs, nodes), p)


def _verified(pairs: DataFrame, text: DataFrame, p: NearDedup) -> DataFrame:
    """The pairs (a, b) whose sets, of ``text`` (node, text), reach the threshold."""

    def verify(it):
        for whole in it:
            for x in batches([whole], 256):
                keep, last = [], {}
                for i, (a, b, u, v) in enumerate(zip(x.column(0).to_pylist(), x.column(1).to_pylist(), text_bytes(x.column(2)), text_bytes(x.column(3)), strict=True)):
                    s, t = (last[k] if k in last else last.setdefault(k, shingle_set(d, p.words)) for k, d in (((a, len(u)), u), ((b, len(v)), v)))
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= p.percent * (len(s) + len(t) - both):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays(list(x.columns[:2]), names=["a", "b"]).take(pa.array(keep, pa.int64()))

    ta = text.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    tb = text.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(verify, "a long, b long")


def _shared(rest: DataFrame, text: DataFrame, p: NearDedup) -> DataFrame:
    """(node, s): how many of a document's shingles another document of ``rest`` also has."""

    def explode(it):
        for whole in it:
            for x in batches([whole], 64):
                sets = [shingle_set(d, p.words) for d in text_bytes(x.column(1))]
                if sets:
                    node = np.repeat(x.column(0).to_numpy(), [len(s) for s in sets])
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "h"])

    alone = text.mapInArrow(explode, "node long, h long").groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    alone = alone.where("node = other").groupBy("node").agg(F.count("*").alias("alone"))
    return rest.select("node", "n").distinct().join(alone, "node", "left").select("node", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s"))


def _crossing(rest: DataFrame, text: DataFrame, p: NearDedup) -> DataFrame:
    """Pairs (a, b) of ``rest`` (bucket, band, node, comp, n, hi) that signatures leave.

    A pair is formed once, in the first band whose bucket hash both share. A bucket of many is cut
    into blocks by a hash, and each pair of blocks is a task's group of at most about two blocks.
    """
    mul, add = p.functions(p.wide)
    bands_of = p.folding()
    steps = p.least_matches(p.wide)

    def widen(it):
        for whole in it:
            for x in batches([whole], 64):
                least = [_least(shingle_set(d, p.words), mul, add) for d in text_bytes(x.column(1))]
                sig = [(v >> np.uint64(56)).astype(np.uint8).tobytes() for v in least]
                bands = [bands_of(v[: p.hashes]).tobytes() for v in least]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(sig, pa.binary()), pa.array(bands, pa.binary())], names=["node", "sig", "bands"])

    def compare(t: pa.Table) -> pa.Table:
        node, comp, n, hi, c, i, j, band = (t.column(k).to_numpy() for k in ("node", "comp", "n", "hi", "c", "i", "j", "band"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(node), p.wide)
        bands = np.frombuffer(b"".join(t.column("bands").to_pylist()), np.int64).reshape(len(node), p.bands)[:, : int(band[0])]
        out = []
        left, right = (np.flatnonzero(c == k[0]) for k in (i, j))
        for at in range(0, len(left), 64):
            u, v = left[at : at + 64, None], right[None, :]
            ok = (comp[u] != comp[v]) & (n[u] <= hi[v]) & (n[v] <= hi[u])
            ok &= (node[u] < node[v]) if i[0] == j[0] else (node[u] != node[v])
            ok &= np.minimum(n[u], n[v]) * 100 >= np.maximum(n[u], n[v]) * p.percent
            x, y = np.nonzero(ok)
            x, y = left[at + x], right[y]
            seen, done = np.zeros(len(x), np.int64), 0
            for m, least in steps:
                seen = seen + (sig[x, done:m] == sig[y, done:m]).sum(axis=1)
                stay = seen >= least
                x, y, seen = x[stay], y[stay], seen[stay]
                if not done:
                    fresh = ~(bands[x] == bands[y]).any(axis=1)
                    x, y, seen = x[fresh], y[fresh], seen[fresh]
                done = m
            out.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]))
        a, b = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    size = rest.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    rows = rest.join(written(size, "size"), "bucket").join(written(text.mapInArrow(widen, "node long, sig binary, bands binary"), "wide"), "node")
    rows = rows.withColumn("c", F.expr("pmod(xxhash64(node), k)")).withColumn("o", F.explode(F.expr("sequence(0L, k - 1)")))
    rows = rows.select("bucket", "band", "node", "comp", "n", "hi", "sig", "bands", "c", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Null and blank texts have no shingles and are linked with nothing. A null doc_id is linked
    with nothing: its component is null and it is kept. Repeated rows share a component and all
    carry its id; rows that repeat a doc_id with other texts each follow their own text. Other
    columns are ignored.
    """
    s = written(signatures(docs, p), "signatures")
    known = s.where("n > 0 and doc_id is not null")
    # A class has a number of its own, as one doc_id may be the smallest of several.
    of_class = known.groupBy("f1", "f2").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    of_class = written(of_class, "classes")
    first = known.join(of_class, (known.f1 == of_class.f1) & (known.f2 == of_class.f2) & (known.doc_id == of_class.least))
    first = written(first.select("node", "doc_id", "th", "n", "bands", "sig").dropDuplicates(["node"]), "first")
    sigs = first.select("node", "doc_id", "th", "sig")

    banded = first.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    full = banded.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("lead"), F.count("*").alias("m")).where("m > 1")
    full = written(full.select("bucket", F.col("lead.node").alias("lead"), F.col("lead.n").alias("ln")), "buckets")
    inside = written(banded.join(full, "bucket").select("bucket", "band", "node", "n", "lead", "ln"), "inside")

    near = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * p.percent)
    stars = inside.where((F.col("node") != F.col("lead")) & near(F.col("n"), F.col("ln")))
    stars = written(stars.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    edges = written(_links(written(_alike(stars, sigs, p), "alike"), docs, p), "links")
    label = components(edges)

    member = inside.join(label, "node", "left").select("bucket", "band", "node", "n", "lead", F.coalesce("comp", "node").alias("comp"))
    member = written(member, "member")
    mixed = member.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    # Pairs with the lead have been compared.
    rest = written(member.where("node != lead").join(written(mixed, "mixed"), "bucket").select("bucket", "band", "node", "n", "comp"), "rest")
    # A partner with k shingles can be alike only if s reaches it: s >= t (n + k - s).
    text = written(_texts(docs, rest.select("node").distinct().join(sigs.select("node", "doc_id", "th"), "node")), "text")
    shared = written(_shared(rest, text, p), "shared")
    rest = rest.join(shared, "node").withColumn("hi", F.expr(f"(s * {100 + p.percent}) div {p.percent} - n")).where(f"100 * s >= {p.percent} * n")
    rest = written(rest.select("bucket", "band", "node", "n", "comp", "hi"), "rest")
    span = rest.groupBy("bucket").agg(F.min("n").alias("lo"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("bucket", "lo")
    rest = written(rest.join(written(span, "span"), "bucket").where("lo <= hi").drop("lo"), "rest")
    more = written(_crossing(rest, text.join(rest.select("node").distinct(), "node"), p), "pairs")
    extra = written(_verified(more, text, p), "links")
    if not extra.isEmpty():
        label = components(edges.unionByName(extra))

    linked = written(of_class.join(label, "node").select("node", "comp", "least"), "linked")
    least = written(linked.groupBy("comp").agg(F.min("least").alias("id")), "least")
    named = written(linked.join(least, "comp").select("node", "id"), "named")
    of_node = written(of_class.join(named, "node", "left").select("f1", "f2", F.coalesce("id", "least").alias("comp")), "components")
    out = s.where("n > 0 and doc_id is not null").join(of_node, ["f1", "f2"]).select("doc_id", "n", "comp")
    out = out.unionByName(s.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("comp")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(True)).alias("kept"))
