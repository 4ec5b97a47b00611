"""Exact top-k search by MaxScore over integer vectors.

Dimensions are the terms. In each shard a query's term has the bound of its contributions; shifted by the least one,
contributions are at least zero, so bounds add up as MaxScore needs. Terms are split by bounds: the essential ones, whose
postings are traversed for every vector, and the non-essential ones, which are probed in order of bound only for vectors
that still may enter the query's current top k. Shards' results are merged by rank.

Queries are a stated set and may grow with the input: they are cut into blocks, and each pair of a block and a shard is
one task's work. Nothing is broadcast.

Defined results: vectors that are null, empty of meaning (null or non-finite components) take no part; vectors of unequal
length are compared as if padded with zeros; equal scores go to the smaller vec_id; a query's own vec_id is no candidate,
however often it occurs; repeated rows are candidates of their own, but a query whose vec_id comes repeatedly is asked
once, with its lowest vector. Components too large for exact arithmetic in doubles go through Python's integers; a
score beyond 64 bits counts as the nearest long. A component whose 256-fold is beyond a double's range is not finite. Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Queries of a block, and rows of a shard (by hash of the vector).
BLOCK, SHARD = 16_384, 8_192
#: Share of a query's bound that its essential terms hold at first.
ESSENTIAL = 0.5


def matrix(rows: pd.Series) -> np.ndarray:
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def plain(ids: np.ndarray, vectors: np.ndarray, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """Scores by Python's integers, for components beyond exact doubles."""
    q = [int(x) for x in q]
    exact = ((sum(a * int(b) for a, b in zip(q, v, strict=True)), int(i)) for i, v in zip(ids, vectors, strict=True) if i != own)
    scored = [(-max(-(2**63), min(2**63 - 1, s)), i) for s, i in exact]
    return [(i, -s) for s, i in sorted(scored)[:k]]


class Shard:
    """Postings of a shard, one row for each term (dimension), with each term's least and greatest value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.postings = np.ascontiguousarray(self.vectors.T)
        self.least, self.most = self.postings.min(axis=1), self.postings.max(axis=1)

    def search(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (vec_id, score), ties to smaller ids."""
        low = np.minimum(q * self.least, q * self.most)
        bound = np.maximum(q * self.least, q * self.most) - low
        order = np.argsort(-bound, kind="stable")
        total = bound.sum()
        first = max(1, int(np.searchsorted(np.cumsum(bound[order]), ESSENTIAL * total)) + 1)
        essential, rest = order[:first], order[first:]
        score = q[essential] @ self.postings[essential] - low[essential].sum()
        left = np.append(np.cumsum(bound[rest][::-1])[::-1], 0)
        at = np.flatnonzero(self.ids != own)
        score = score[at]
        if len(at) > k:  # the current top k: the leaders by essential terms, scored in full
            lead = at[np.argpartition(-score, k - 1)[:k]]
            floor = (self.vectors[lead] @ q).min() - low.sum()
            keep = score + left[0] >= floor
            at, score = at[keep], score[keep]
            step = 4
            for i in range(0, len(rest), step):
                terms = rest[i : i + step]
                score = score + q[terms] @ self.postings[np.ix_(terms, at)] - low[terms].sum()
                if len(at) > k:
                    j = min(i + step, len(rest))
                    floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
                    keep = score + left[j] >= floor
                    at, score = at[keep], score[keep]
        full = self.vectors[at] @ q
        best = np.lexsort((self.ids[at], -full))[:k]
        return [(int(self.ids[at[b]]), int(full[b])) for b in best]


def search_pair(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            both = matrix(pd.concat([queries["v"], vectors["v"]], ignore_index=True))
            asked, held, ids = both[: len(queries)], both[len(queries) :], vectors["vec_id"].to_numpy()
            exact = both.shape[1] * np.abs(asked).max(initial=0) * np.abs(held).max(initial=0) * 4 < 2**53
            shard = Shard(ids, held) if exact and both.shape[1] else None
            for own, q in zip(queries["vec_id"], asked, strict=True):
                found = shard.search(q, own, k) if shard else plain(ids, held, q, own, k)
                out += [(int(own), i, s) for i, s in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and vectors (vec_id long, v array<double> of whole numbers)."""
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks, n_shards = max(1, -(-queries.count() // block)), max(1, -(-vectors.count() // shard))
    pair = lambda b, s: [b.cast("int").alias("block"), s.cast("int").alias("shard")]
    asked = queries.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).select("vec_id", "v", *pair(F.col("b"), F.col("s")))
    held = vectors.withColumn("s", F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(n_shards))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select("vec_id", "v", *pair(F.col("b"), F.col("s")))
    found = asked.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInPandas(search_pair(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(rows: DataFrame) -> DataFrame:
    """Rows whose vectors are whole and finite, components turned into floor(256 x)."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * 256) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select("vec_id", F.transform(x, lambda c: F.rint(c * 256 - F.pmod(c * 256, F.lit(1.0)))).alias("v"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
