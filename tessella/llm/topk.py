"""Exact top-k search by columnar branch and bound (operator 10).

Components become integers, floor(256 x). Queries and candidates are dealt to blocks, and each pair of a
query block and a candidate block is one task's work. Inside, candidates lie dimension by dimension, most
varied dimensions first. Scores grow block of dimensions by block of dimensions; what is still to come is at
most the product of the remaining norms, so that a candidate whose bound lies below the k-th best score
known is dropped and the survivors are compacted. The first candidate block is searched first, and its k-th best score
of a query is the one to beat in all others. The best k of all block pairs meet in a window by query.

Sums are exact: products are added as doubles where all sums stay below 2^53, and as Python integers beyond.

Edge cases: vectors that are null or hold null or non-finite components take no part, as query or candidate, nor do those
without vec_id; vectors meet only vectors of their own length; ties go to the smaller vec_id; equal rows repeated under
one id are one candidate; scores that no long can hold are an error; empty tables give no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

K, DIMENSIONS, QUERY_ROWS, CANDIDATE_ROWS = 5, 8, 8192, 16384
#: Queries that a task works on at a time.
PART_ROWS = 256
OUT = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<double> of whole numbers, dim) for the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("double"))
    sound = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    large = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**50, F.floor(c * F.lit(scale)).cast("double")).otherwise(c * F.lit(scale)))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), large.alias("v"), F.size(x).alias("dim")).distinct()


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.array([[sum(int(a) * int(b) for a, b in zip(q, r)) for r in rows] for q in queries], dtype=object)


def search(query_ids, queries, least, ids, columns, k=K, step=DIMENSIONS) -> list[tuple[int, int, int]]:
    """The k best (query, candidate, score) of each query among the scores not below its least; columns holds a candidate
    per column, ids ascending."""
    dim = len(columns)
    if np.abs(queries).max(initial=0) * np.abs(columns).max(initial=0) * dim >= 2.0**52:
        scores = exact(queries, columns.T)
        best = [(q, sorted(((-int(s), int(c)) for s, c in zip(row, ids) if c != q))[:k]) for q, row in zip(query_ids, scores)]
        return [(int(q), c, -s) for q, found in best for s, c in found]
    order = np.argsort(-columns.var(axis=1), kind="stable")
    columns, queries = columns[order], queries[:, order]
    rest = lambda x, axis: np.sqrt(np.maximum(np.cumsum((x**2)[:, ::-1] if axis else (x**2)[::-1], axis=axis), 0))
    column_rest = np.vstack([rest(columns, 0)[::-1], np.zeros(columns.shape[1])])  # norm of dimensions d.. of each candidate
    query_rest = np.hstack([rest(queries, 1)[:, ::-1], np.zeros((len(queries), 1))])
    # The first candidates by length give every query k scores to beat.
    seed = np.argsort(-column_rest[0], kind="stable")[: 4 * k]
    first = queries @ columns[:, seed]
    first[np.asarray(query_ids)[:, None] == ids[seed][None, :]] = -np.inf
    known = np.maximum(np.sort(first, axis=1)[:, -k], least) if len(seed) >= k else least
    lead = min(2 * step, dim)
    found = []
    for n, q in enumerate(query_ids):
        if n % PART_ROWS == 0:
            partial = queries[n : n + PART_ROWS, :lead] @ columns[:lead]
        score, low = partial[n % PART_ROWS], known[n]
        near = np.flatnonzero(score + query_rest[n, lead] * column_rest[lead] * (1 + 1e-9) + 1e-6 >= low)
        score = score[near]
        for d in range(lead, dim, step):
            e = min(d + step, dim)
            score = score + queries[n, d:e] @ columns[d:e, near]
            slack = query_rest[n, e] * column_rest[e, near] * (1 + 1e-9) + 1e-6
            if len(score) > k:  # k candidates reach at least this
                low = max(low, np.partition(score - slack, -k - 1)[-k - 1])
            stay = score + slack >= low
            near, score = near[stay], score[stay]
        own = ids[near] != q
        near, score = near[own], score[own]
        top = np.lexsort((ids[near], -score))[:k]
        found += [(int(q), int(ids[near[t]]), int(score[t])) for t in top]
    return found


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row."""
    rows = integers(vectors)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    q_blocks, c_blocks = max(1, -(-sizes["q"] // QUERY_ROWS)), max(1, -(-sizes["n"] // CANDIDATE_ROWS))
    number = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda first, end: F.explode(F.sequence(F.lit(first), F.lit(end - 1)))
    candidates = rows.select("vec_id", "v", "dim", number(c_blocks).alias("cb"), each(0, q_blocks).alias("qb"))
    queries = rows.where(is_query).select("vec_id", "v", "dim", number(q_blocks).alias("qb"))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = t.sort_by("vec_id")
        v = t.column("v").combine_chunks()
        return t.column("vec_id").to_numpy(), v.flatten().to_numpy().reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            query_ids, q = matrix(left)
            ids, x = matrix(right)
            found = search(query_ids, q, left.sort_by("vec_id").column("least").to_numpy(), ids, np.ascontiguousarray(x.T), k)
        cols = list(zip(*found)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    block = lambda df: df.groupBy("dim", "qb", "cb")
    best = block(queries.withColumn("cb", F.lit(0)).withColumn("least", F.lit(float("-inf")))).cogroup(block(candidates.where("cb = 0"))).applyInArrow(run, OUT)
    if c_blocks > 1:
        best = materialise(best, "first")
        beat = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("least").cast("double").alias("least"))
        queries = queries.join(beat, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))).withColumn("cb", each(1, c_blocks))
        queries = queries.toDF(*queries.columns)
        best = best.union(block(queries).cogroup(block(candidates.where("cb > 0"))).applyInArrow(run, OUT))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return best.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
with v as (select vec_id, list_transform(embedding::double[], lambda x: floor(256 * x)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
