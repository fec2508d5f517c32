"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are those of itself and of its two neighbours, and the
chain joins the labels of successive lines. Forward-backward gives each line's marginal; their
mean, weighted by line length, is calibrated to a document's score.

The chain learns from documents' labels: all lines of a good document count as good, all of a
bad one as bad.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.llm.common import batches, written

#: Labelled documents, and lines of them in all, that the fit uses at most: the first documents by a
#: hash of their ids, each whole; one whose lines would go beyond is left out.
MAX_LABELLED, MAX_LINES = 2500, 500_000
ACCEPT = 0.7
N = 18
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Rows that no fit uses: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _classes() -> np.ndarray:
    """Of each byte: upper, lower, digit, blank, sentence mark, other ASCII, beyond ASCII."""
    c = np.full(256, 5, np.int64)
    c[65:91], c[97:123], c[48:58], c[128:] = 0, 1, 2, 6
    c[[32, 9, 13]] = 3
    c[[ord(x) for x in ".,;:?'-\"()"]] = 4
    return c


_CLASS = _classes()


def lines_of(text: str) -> list[str]:
    """The lines that are not blank; of a blank text none."""
    return [x for x in text.split("\n") if x and not x.isspace()]


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of a document's lines."""
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    size = np.array([len(x) for x in raw], np.float64)
    at = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    kind = _CLASS[data]
    f = np.zeros((len(lines), N))
    for k in range(7):
        f[:, k] = np.add.reduceat(kind == k, at) / size
    same = np.zeros(len(data), bool)
    same[1:] = data[1:] == data[:-1]
    same[at] = False
    f[:, 7] = np.add.reduceat(same, at) / size
    f[:, 8] = np.log1p(size) / 5
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    vocabulary: dict[str, int] = {}
    total = 0
    for i, x in enumerate(lines):
        words = x.split()
        own = set(words)
        n = len(words)
        f[i, 9] = len(own) / n
        f[i, 10] = min(n, 200) / 50
        f[i, 11] = (len(x) - n + 1) / n / 8
        f[i, 12] = x[-1] in ".!?\""
        f[i, 13] = seen[x] > 1
        f[i, 14] = sum(1 for w in own if not w[-1].isalnum()) / len(own)
        f[i, 15] = sum(1 for w in own if w[0].isalpha()) / len(own)
        f[i, 16] = len(own) < 0.3 * n
        total += n
        for w in own:
            vocabulary[w] = vocabulary.get(w, 0) + 1
    f[:, 17] = min(1.0, len(vocabulary) / max(1, total))
    return f, size


def neighbours(f: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features of each line, the one before and the one after, and 1."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[starts], after[ends - 1] = 0, 0
    return np.concatenate([f, before, after, np.ones((len(f), 1))], axis=1)


def forward_backward(node: np.ndarray, trans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginals, summed pair marginals, summed log-partition) of the chains ``starts:ends``.

    ``node`` holds each line's log-potentials of bad and good. The chains advance together.
    """
    order = np.argsort(-(ends - starts), kind="stable")
    first, size = starts[order], (ends - starts)[order]
    alpha, beta = np.empty_like(node), np.zeros_like(node)
    longest = int(size[0]) if len(size) else 0
    count = np.searchsorted(-size, -np.arange(longest), side="left")  # chains with more than t lines
    lse = np.logaddexp
    alpha[first] = node[first]
    for t in range(1, longest):
        i = first[: count[t]] + t
        a = alpha[i - 1]
        for y in (0, 1):
            alpha[i, y] = node[i, y] + lse(a[:, 0] + trans[0, y], a[:, 1] + trans[1, y])
    for t in range(longest - 2, -1, -1):
        i = first[: count[t + 1]] + t
        b = beta[i + 1] + node[i + 1]
        for y in (0, 1):
            beta[i, y] = lse(trans[y, 0] + b[:, 0], trans[y, 1] + b[:, 1])
    z = lse(alpha[first + size - 1, 0], alpha[first + size - 1, 1])
    of = np.empty(len(node))
    for s, n, v in zip(first, size, z, strict=True):
        of[s : s + n] = v
    marginal = np.exp(alpha + beta - of[:, None])
    inner = np.ones(len(node), bool)
    inner[starts] = False
    j = np.flatnonzero(inner)
    pair = np.empty((2, 2))
    for u in (0, 1):
        for v in (0, 1):
            pair[u, v] = np.exp(alpha[j - 1, u] + trans[u, v] + node[j, v] + beta[j, v] - of[j]).sum()
    return marginal, pair, float(z.sum())


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float

    def raw(self, f: np.ndarray, sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The log-odds of each document's length-weighted mean marginal."""
        x = neighbours(np.clip((f - self.mean) / self.scale, -6, 6), starts, ends)
        node = np.zeros((len(f), 2))
        node[:, 1] = x @ self.weight
        good = forward_backward(node, self.trans, starts, ends)[0][:, 1]
        share = np.clip(np.add.reduceat(good * sizes, starts) / np.add.reduceat(sizes, starts), 1e-6, 1 - 1e-6)
        return np.log(share / (1 - share))

    def score(self, f, sizes, starts, ends) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(f, sizes, starts, ends) + self.offset)))


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, quality, n, f, sizes) per labelled document: n lines; f is flat."""

    def run(it):
        for b in batches(it):
            f, sizes = [], []
            for text in b.column(2).to_pylist():
                lines = lines_of(text or "")
                x, s = line_features(lines) if lines else (np.zeros((0, N)), np.zeros(0))
                f.append(x.ravel()), sizes.append(s)
            n = pa.array([len(s) for s in sizes], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(f, pa.list_(pa.float64())), pa.array(sizes, pa.list_(pa.float64()))], names=["doc_id", "quality", "n", "f", "sizes"])

    return docs.select("doc_id", F.col("quality").cast("int"), "text").mapInArrow(run, "doc_id long, quality int, n long, f array<double>, sizes array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = 100, max_lines: int = MAX_LINES) -> Model:
    """A model from at most ``max_labelled`` labelled documents, none of them held out, with at most
    ``max_lines`` lines.

    Of rows that repeat a doc_id the one of the smallest text counts; a document labelled both
    ways counts as both. Without labelled documents of both kinds the score is a constant 1 or 0:
    the kind there is, or 1.
    """
    first = F.xxhash64("doc_id")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    known = known.orderBy(first, "doc_id", "quality").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    found = written(_features(texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))), "features")
    used, room = [], max_lines
    for r in found.select("doc_id", "n").distinct().orderBy(first, "doc_id").collect():
        if r.n <= room:
            used.append((r.doc_id,))
            room -= r.n
    some = docs.sparkSession.createDataFrame(used, "doc_id long")
    rows = found.join(F.broadcast(some), "doc_id").orderBy(first, "doc_id", "quality").toArrow()
    y = rows.column("quality").to_numpy()
    parts = [np.asarray(x).reshape(-1, N) for x in rows.column("f").to_numpy()]
    some = np.array([len(x) > 0 for x in parts], bool)
    y = y[some] if len(y) else y
    if len(set(y.tolist())) < 2:
        only = float(y[0]) if len(y) else 1.0
        return Model(np.zeros(N), np.ones(N), np.zeros(3 * N + 1), np.zeros((2, 2)), 0.0, 30.0 if only else -30.0)
    f = np.concatenate(parts)
    sizes = np.concatenate([np.asarray(x) for x in rows.column("sizes").to_numpy()])
    n = np.array([len(x) for x in parts if len(x)])
    ends = np.cumsum(n)
    starts = ends - n
    mean, scale = f.mean(axis=0), f.std(axis=0) + 1e-3
    x = neighbours(np.clip((f - mean) / scale, -6, 6), starts, ends)
    line = np.repeat(y, n)
    # Both kinds and all documents weigh alike, whatever their count and length.
    per_doc = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    per_line = np.repeat(per_doc / n, n)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    same = np.array([[0.0, 0.0], [0.0, 0.0]])
    share = ((y == 1) * per_doc).sum()
    same[1, 1], same[0, 0] = share, 1 - share
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, trans)]
    for step in range(1, rounds + 1):
        node = np.zeros((len(f), 2))
        node[:, 1] = x @ w
        marginal, pair, _ = forward_backward(node, trans, starts, ends)
        grads = (x.T @ ((line - marginal[:, 1]) * per_line) - 1e-3 * w, same - pair / max(1.0, pair.sum()) - 0.05 * trans)
        for p, g, (m, v) in zip((w, trans), grads, state, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p += 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(mean, scale, w, trans, 1.0, 0.0)
    raw = model.raw(f, sizes, starts, ends)
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit
        p = 1 / (1 + np.exp(-(slope * raw + offset)))
        r, h = y - p, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(r * raw).sum() - 1e-2 * (slope - 1), r.sum()])
        hess = np.array([[(h * raw * raw).sum() + 1e-2, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(hess, g)
        slope, offset = max(1e-3, slope + float(np.clip(d[0], -1, 1))), offset + float(np.clip(d[1], -1, 1))
    return Model(mean, scale, w, trans, slope, offset)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` (which has text) and ``quality_score``, last.

    Null texts and those of blank lines only have nothing to judge and score 0. Repeated rows
    score alike. A column of that name is replaced.
    """
    docs = docs.drop("quality_score")
    at = docs.columns.index("text")

    def run(it):
        for b in batches(it):
            score = np.zeros(b.num_rows)
            f, sizes, who, n = [], [], [], []
            for i, text in enumerate(b.column(at).to_pylist()):
                lines = lines_of(text or "")
                if lines:
                    x, s = line_features(lines)
                    f.append(x), sizes.append(s), who.append(i), n.append(len(lines))
            if who:
                ends = np.cumsum(n)
                score[who] = model.score(np.concatenate(f), np.concatenate(sizes), ends - np.array(n), ends)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "quality_score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("quality_score", DoubleType())]))
