"""Exact top-k inner products by no-random-access aggregation (NRA).

Queries and candidates are dealt into blocks of bounded size; a task meets one
pair of blocks.  It takes the candidates in portions.  A portion has, for every
dimension, a list of its values in order.  A query reads the lists of its
components step by step, from the top where the component is positive and from
the bottom where it is negative, and knows of each candidate

* a lower bound: what was read of it, and for the rest the far ends of the lists;
* an upper bound: what was read of it, and for the rest where reading stands.

Candidates whose upper bound is under the k-th best score of the portions before,
or, in the first portion, under the k-th best lower bound, are outsiders.  Queries read the lists side by
side, so that the bounds of a step are products of matrices; each query stops on its own,
when so few others are left that resolving their scores takes less than the next
step; a portion whose lists begin too low is not read at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16_384  # candidates in a block
QUERY_BLOCK = 1024
PORTION = 2048  # candidates whose lists are read together
TOGETHER = 512  # queries that read them side by side
FIRST = 32  # the first step reads one FIRST-th of each list, each further one twice the last
SCHEMA = "query_id long, vec_id long, score long"


def exact_kind(x: np.ndarray, q: np.ndarray):
    """The narrowest type in which all sums of products are exact."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def least_of(kind):
    """Less than any score."""
    return np.iinfo(np.int64).min if kind == np.int64 else -np.inf


class Lists:
    """A portion of the candidates with a sorted list for every dimension, read from both ends in step."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(x, self.order, axis=0)
        self.dims = np.arange(x.shape[1])

    def steps(self) -> Iterator[tuple]:
        """After each step: how many of every list are read, how many the next step reads, and of every candidate
        and dimension what was read, and where reading stands for what was not, from the top and from the bottom;
        then the same with the lists' far ends for what was not read, made when asked for."""
        n, at, step = len(self.ids), 0, max(1, len(self.ids) // FIRST)
        top, bottom = np.empty_like(self.x), np.empty_like(self.x)
        rest = np.ones((2, *self.x.shape), bool)
        while at < n:
            to = min(n, at + step)
            for known, unread, rows, edge in ((top, rest[0], slice(n - to, n - at), n - to), (bottom, rest[1], slice(at, to), to - 1)):
                who = self.order[rows]
                known[who, self.dims] = self.values[rows]
                unread[who, self.dims] = False
                np.copyto(known, self.values[edge], where=unread)
            at, step = to, 2 * step
            yield at, step, top, bottom, lambda: (np.where(rest[0], self.values[0], top), np.where(rest[1], self.values[-1], bottom))


def survivors(q: np.ndarray, lists: Lists, own: np.ndarray, bar: np.ndarray, k: int, read: dict) -> Iterator[tuple[int, np.ndarray]]:
    """(query, candidates that can be among its k best and have ``bar`` or more) for every query that has any.

    The queries read the lists side by side, and each stops on its own.  own[i, j]: candidate j takes no part
    in query i.  bar: the k-th best score of the portions before, ``least_of`` where they did not give k.

    read["list"] counts the components that were read."""
    n, none, before = len(lists.ids), least_of(q.dtype), 0
    up, down, used = np.maximum(q, 0), np.minimum(q, 0), np.count_nonzero(q, axis=1)
    bar, given = bar.copy(), bar > none
    going = np.flatnonzero(up @ lists.values[-1] + down @ lists.values[0] >= bar)
    for at, step, top, bottom, far in lists.steps():
        if not len(going):
            return
        read["list"] += (at - before) * int(used[going].sum())
        before = at
        fresh = going[~given[going]]
        if len(fresh) and n >= k:
            # the k-th best lower bound takes the place of the k-th best score
            top_far, bottom_far = far()
            least = up[fresh] @ top_far.T + down[fresh] @ bottom_far.T
            least[own[fresh]] = none
            bar[fresh] = np.maximum(bar[fresh], np.partition(least, n - k, axis=1)[:, n - k])
        # equal bounds may still win by id, so only smaller ones are outsiders
        alive = (up[going] @ top.T + down[going] @ bottom.T >= bar[going, None]) & ~own[going]
        left = np.count_nonzero(alive, axis=1)
        done = (left <= step) | (at == n)
        for i in np.flatnonzero(done & (left > 0)):
            yield int(going[i]), np.flatnonzero(alive[i])
        going = going[~done]


def nra_topk(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, x: np.ndarray, k: int, read: dict | None = None) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best in the block, ties to the smaller vector.

    q, x: integers.  Candidates with the query's own id take no part.  read
    counts components: "list" in order, "final" to resolve scores."""
    read = {} if read is None else read
    read |= {"list": 0, "final": 0}
    kind = exact_kind(x, q)
    q, x = q.astype(kind), x.astype(kind)
    none = least_of(kind)
    best: list[list] = [[] for _ in qid]
    for at in range(0, len(x), PORTION):
        lists = Lists(vid[at : at + PORTION], x[at : at + PORTION])
        for begin in range(0, len(qid), TOGETHER):
            some = range(begin, min(len(qid), begin + TOGETHER))
            bar = np.array([-best[i][k - 1][0] if len(best[i]) >= k else none for i in some], kind)
            own = qid[begin : begin + TOGETHER, None] == lists.ids
            for i, left in survivors(q[begin : begin + TOGETHER], lists, own, bar, k, read):
                read["final"] += lists.x.shape[1] * len(left)
                scores = (lists.x[left] @ q[begin + i]).astype(np.int64)
                good = scores >= bar[i]
                scores, left = scores[good], left[good]
                best[begin + i] = sorted(best[begin + i] + list(zip((-scores).tolist(), lists.ids[left].tolist(), strict=True)))[:k]
    return [(int(i), v, -s) for i, found in zip(qid, best, strict=True) for s, v in found]


def quantise(v, scale: int):
    return F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` over ``vectors(vec_id, embedding)``.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all
    rows but the query's own id.

    * Vectors that are null or hold null or non-finite components take no part;
      neither do rows without vec_id.  Vectors of other lengths than the query's
      are not compared with it; empty ones score 0 with each other.
    * Every repeated row is a candidate; the results of repeated query rows are
      ranked together.  Ties go to the smaller vec_id; fewer than k candidates
      give all.  Other columns are ignored.  Empty table: empty.
    """
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clean = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(~bad)
        .select("vec_id", quantise(F.col("embedding"), scale).alias("v"))
        .withColumn("dim", F.size("v"))
    )
    from quire.llm.store import materialize

    clean = materialize(clean)
    asked = clean.where(F.col("vec_id") % every == 0)
    n, m = clean.count(), asked.count()
    blocks, query_blocks = -(-n // block) or 1, -(-m // query_block) or 1

    def dealt(c, parts):
        return F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")

    def every_of(parts):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    # each row goes once to every block of the other side, and no pair of rows is formed outside a task
    # the vector is part of the hash: many rows of one id are spread
    rows = clean.select("dim", "vec_id", "v", dealt(F.struct("vec_id", "v"), blocks).alias("b"), every_of(query_blocks).alias("qb"))
    queries = asked.select("dim", "vec_id", "v", dealt(F.struct("vec_id", "v"), query_blocks).alias("qb"), every_of(blocks).alias("b"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            flat = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return t["vec_id"].to_numpy(), flat.reshape(t.num_rows, -1)

        found = []
        if left.num_rows and right.num_rows:
            found = nra_topk(*matrix(left), *matrix(right), k)
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    keys = ["dim", "b", "qb"]
    found = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meet, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("*", rank.cast("int").alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark, sf_dir):
    from quire.llm.store import read_table

    return top_k(read_table(spark, sf_dir, "embeddings"))


OP5_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
