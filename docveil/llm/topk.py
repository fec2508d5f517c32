"""Exact top-k search by inner product with MaxScore.

A dimension is a term and its non-zero components are its postings. A shard (a run of rows) keeps
each term's largest and smallest component, which bound a query's score term by term. The terms of
least bounds whose sum can't lift a row over the query's k-th best score are non-essential: rows
are gathered from the essential terms' postings, and the others are probed, largest bound first,
only for rows that can still compete. Shards keep k rows per query and are merged.

Rows are dealt to shards and queries to blocks by one exchange, and a task's group is a shard and a
block; so neither the rows nor the queries are ever in one place, and the driver sees only counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard and queries of a block, about: at 64 dimensions, 8 MB and 4 MB.
SHARD, BLOCK = 16_384, 8192


class Shard:
    """Rows (ids ascending) with integer components, as float64 whose sums are exact."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.terms = np.asfortranarray(self.rows)
        self.high, self.low = np.maximum(self.rows.max(axis=0), 0), np.minimum(self.rows.min(axis=0), 0)
        self.dense = (self.rows != 0).mean(axis=0) > 0.5

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best rows but the query's own."""
        bound = np.maximum(q * self.high, q * self.low)
        order = np.argsort(bound, kind="stable")
        rest = np.concatenate(([0.0], np.cumsum(bound[order])))  # rest[i]: bound of the first i terms
        own = self.ids == query_id
        # A few rows that share the query's largest terms give a first k-th best score.
        top = order[-8:]
        guess = self.terms[:, top] @ q[top]
        guess[own] = -np.inf
        n = len(guess) - int(own.sum())
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0)
        take = np.argpartition(-guess, min(4 * k, n) - 1)[: min(4 * k, n)]
        exact = self.rows[take] @ q
        best = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
        split = int(np.searchsorted(rest, best, side="left"))  # rest[split - 1] < best: the first split - 1 terms
        split = max(0, min(split - 1, len(order)))
        if best <= 0:
            split = 0
        essential = order[split:]
        if not len(essential):
            essential, split = order[-1:], len(order) - 1
        if best > 0 and not self.dense[essential].any():
            live = np.flatnonzero((self.terms[:, essential] != 0).any(axis=1) & ~own)
            partial = self.terms[np.ix_(live, essential)] @ q[essential]
        else:
            live = np.flatnonzero(~own)
            partial = (self.terms[:, essential] @ q[essential])[live]
        at = split
        while at:
            stay = partial + rest[at] >= best
            live, partial = live[stay], partial[stay]
            if not len(live):
                break
            low = max(0, at - 8)
            some = order[low:at]
            partial = partial + self.rows[np.ix_(live, some)] @ q[some]
            if low and len(partial) > k:
                lowest = -np.maximum(q * -self.high, q * -self.low)[order]  # the least that terms can add
                best = max(best, np.partition(partial, len(partial) - k)[len(partial) - k] + lowest[:low].sum())
            at = low
        stay = partial >= best
        live, partial = live[stay], partial[stay]
        pick = np.lexsort((self.ids[live], -partial))[:k]
        return live[pick], partial[pick]


def _searched(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(places, scores) of each query's k best rows."""
    most = [max(int(x.max()), -int(x.min())) for x in (rows, queries)]
    if most[0] * most[1] * rows.shape[1] < 1 << 53:
        shard = Shard(ids, rows.astype(np.float64))
        found = [shard.search(own, q, k) for own, q in zip(query_ids.tolist(), queries.astype(np.float64), strict=True)]
        return [i for i, _ in found], [s.astype(np.int64) for _, s in found]
    # Sums that a float64 can't hold are made of Python's numbers.
    wide, places, scores = rows.astype(object), [], []
    for own, q in zip(query_ids.tolist(), queries.astype(object), strict=True):
        best = sorted((-s, i, at) for at, (s, i) in enumerate(zip((wide @ q).tolist(), ids.tolist(), strict=True)) if i != own)[:k]
        places.append(np.array([at for _, _, at in best], np.int64))
        scores.append(np.array([min(2**63 - 1, max(-(2**63), -s)) for s, _, _ in best], np.int64))
    return places, scores


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD, block_queries: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of the largest inner product.

    Both have id (long) and vector (array of integers, as double or long). A query's own row, that
    is any of its id, is left out; ties go to the smaller id. A query with fewer than k other rows
    gets them all. Null ids, null vectors, empty vectors and vectors with nulls take no part.
    Repeated rows each count as a row; of queries that repeat an id the one of the smallest vector
    is asked. Vectors of another length than a query's are not compared with it. Components beyond
    a long are taken as its nearest bound, and so are scores, which are exact up to there.
    """
    whole = F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()) & (F.size("vector") > 0)
    cast = lambda df: df.select(F.col("id").cast("long"), F.transform("vector", lambda x: F.floor(x)).alias("vector")).where(whole)
    rows, asked = cast(rows), cast(queries)
    shards, blocks = (F.lit(max(1, -(-df.count() // n))) for df, n in ((rows, shard_rows), (asked, block_queries)))
    # Equal rows are one row with a count, so that many copies are not one shard.
    rows = rows.groupBy("id", "vector").agg(F.least(F.count("*"), F.lit(k).cast("long")).alias("copies"))
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"))
    size = F.size("vector").alias("size")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    left = rows.select("id", "vector", "copies", size, F.pmod(F.xxhash64("id", "vector"), shards).cast("int").alias("shard"), every(blocks).alias("block"))
    right = asked.select("id", "vector", size, every(shards).alias("shard"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))

    def search(t: pa.Table, q: pa.Table) -> pa.Table:
        if not t.num_rows or not q.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score", "copies")})
        ids, query_ids = t.column("id").to_numpy(), q.column("id").to_numpy()
        places, scores = _searched(ids, _matrix(t.column("vector")), query_ids, _matrix(q.column("vector")), k)
        at = np.concatenate(places)
        return pa.table({"query_id": np.repeat(query_ids, [len(x) for x in places]), "vec_id": ids[at], "score": np.concatenate(scores), "copies": t.column("copies").to_numpy()[at]})

    on = ("size", "shard", "block")
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(search, "query_id long, vec_id long, score long, copies long")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
