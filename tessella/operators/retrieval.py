"""Retrieval over vector columns: top-k, knee cut-offs, merges, neighbourhood blends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import cosine
from tessella.sources.curate import first_per_key


#: Vectors that a task multiplies with its queries at a time, queries of such a block, and queries of a matrix of scores.
BLOCK_ROWS, QUERY_ROWS, CHUNK_ROWS = 8192, 4096, 64


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, *, payload: str | None = None, least: float = -1.0) -> DataFrame:
    """(qid, id, score): the k nearest vectors of each query, of its own payload if one is named, by cosine rounded to 6, then id. queries:
    (qid, q[, payload]); vectors: (id, v[, payload]). Both are dealt to blocks, and a task has the matrix of products of a
    pair of blocks; a query goes once to each block of vectors, a vector to each block of queries."""
    sizes = [-(-df.count() // n) or 1 for df, n in ((queries, QUERY_ROWS), (vectors, BLOCK_ROWS))]
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = F.col(payload) if payload else F.lit(0)
    left = queries.select("qid", "q", group.alias("g"), number("qid", sizes[0]).alias("a"), each(sizes[1]).alias("b"))
    right = vectors.select("id", "v", group.alias("g"), number("id", sizes[1]).alias("b"), each(sizes[0]).alias("a"))
    out = f"qid {dict(queries.dtypes)['qid']}, id {dict(vectors.dtypes)['id']}, score double"

    def unit(column: pd.Series) -> np.ndarray:
        x = np.array(column.to_list(), float)
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        length[~(length > 0)] = np.nan
        x /= length[:, None]
        return x

    def best(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if own.empty or near.empty:
            return pd.DataFrame({"qid": own["qid"][:0], "id": near["id"][:0], "score": np.zeros(0)})
        q, v, ids, found = unit(own["q"]), unit(near["v"]), near["id"].to_numpy(), []
        for n in range(0, len(q), CHUNK_ROWS):
            scores = q[n : n + CHUNK_ROWS] @ v.T
            np.nan_to_num(scores, copy=False, nan=-np.inf)
            low = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
            i, j = np.nonzero((scores >= low[:, None] - 2e-6) & np.isfinite(scores))  # ties once rounded are left to the order by id
            found.append(pd.DataFrame({"qid": own["qid"].to_numpy()[n + i], "id": ids[j], "score": scores[i, j]}))
        return pd.concat(found)

    pairs = left.groupBy("g", "a", "b").cogroup(right.groupBy("g", "a", "b")).applyInPandas(best, out)
    scored = pairs.withColumn("score", F.round("score", 6)).where(F.col("score") >= least)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def knee(scores: Column, n: Column, sensitivity: float) -> Column:
    """Index of the knee of n scores in descending order, or -1, by Kneedle (Satopää et al. 2011) for a convex decreasing curve: the first
    local maximum of the difference curve from which it falls below its threshold before the next one."""
    at = lambda i: 1 - (F.get(scores, i) - F.get(scores, n - 1)) / (F.get(scores, F.lit(0)) - F.get(scores, n - 1)) - i / (n - 1)
    start = F.struct(F.lit(-1).alias("peak"), F.lit(0.0).alias("limit"), F.lit(-1).alias("found"))

    def step(state: Column, i: Column) -> Column:
        rises = (i < n - 1) & (at(i) >= at(i - 1)) & (at(i) > at(i + 1))
        peak = F.struct(i.alias("peak"), (at(i) - F.lit(sensitivity) / (n - 1)).alias("limit"), state.found.alias("found"))
        falls = (state.peak >= 0) & (at(i) < state.limit)
        done = F.struct(state.peak.alias("peak"), state.limit.alias("limit"), state.peak.alias("found"))
        return F.when(state.found >= 0, state).when(rises, peak).when(falls, done).otherwise(state)

    curved = (n >= 3) & (F.get(scores, F.lit(0)) > F.get(scores, n - 1))
    return F.when(curved, F.aggregate(F.sequence(F.lit(1), n - 1), start, step).found).otherwise(-1)


def knee_cut(hits: DataFrame, sensitivity: float = 0.5, fallback: str = "all") -> DataFrame:
    """hits (qid, id, score) down to the score at the knee of each query. Without a knee all stay, or
    those from the median up (fallback "median"). A query's hits are a top-k, so its array is small."""
    rows = hits.where("score is not null").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "id")), asc=False).alias("rows"))
    rows = rows.select("qid", "rows", F.transform("rows", lambda x: x.score.cast("double")).alias("s"), F.size("rows").alias("n"))
    rows = rows.withColumn("k", knee(F.col("s"), F.col("n"), sensitivity))
    middle = lambda m: F.get("s", F.floor(m).cast("int"))
    none = (middle((F.col("n") - 1) / 2) + middle(F.col("n") / 2)) / 2 if fallback == "median" else F.get("s", F.col("n") - 1)
    low = F.when(F.col("k") >= 0, F.get("s", F.col("k"))).otherwise(none)
    return rows.withColumn("low", low).select("qid", "low", F.explode("rows").alias("x")).where("x.score >= low").select("qid", "x.id", "x.score")


def share_cut(hits: DataFrame, share: float = 0.2) -> DataFrame:
    """Down to the score at the top share of each query, one hit at least."""
    w = Window.partitionBy("qid")
    ranked = hits.withColumn("rn", F.row_number().over(w.orderBy(F.desc("score"), "id"))).withColumn("n", F.count("*").over(w))
    low = F.min(F.when(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * share)), F.col("score"))).over(w)
    return ranked.withColumn("low", low).where("score >= low").select("qid", "id", "score")


def merged(*hits: DataFrame) -> DataFrame:
    """The best score of each (qid, id) over several searches."""
    rows = hits[0]
    for h in hits[1:]:
        rows = rows.unionByName(h)
    return rows.groupBy("qid", "id").agg(F.max("score").alias("score"))


def blend(vectors: DataFrame, neighbours: DataFrame, own: float = 0.9, weights: tuple[float, ...] = (1.0, 0.7, 0.3)) -> DataFrame:
    """(id, v): unit vectors of own x self + (1 - own) x the weighted mean of the neighbours (root, node, kind),
    kind naming a weight by its number; without neighbours the vector stays."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.least(F.col("kind").cast("int") + 1, F.lit(len(weights))))
    parts = neighbours.select("root", F.col("node").alias("id"), w.alias("w")).join(vectors, "id").select("root", "w", F.posexplode("v").alias("i", "x"))
    mean = parts.groupBy("root", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    mean = mean.groupBy(F.col("root").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("m"))
    mixed = F.when(F.col("m").isNull(), F.transform("v", lambda x: x.cast("double"))).otherwise(F.zip_with("v", "m", lambda x, m: own * x.cast("double") + (1 - own) * m))
    rows = vectors.join(mean, "id", "left").select("id", mixed.alias("b"))
    length = F.sqrt(F.aggregate("b", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("len", length).select("id", F.when(F.col("len") > 0, F.transform("b", lambda x: x / F.col("len"))).otherwise(F.col("b")).alias("v"))


def relevance(rows: DataFrame, vector: str, query: list[float]) -> DataFrame:
    """rows by their cosine to one query vector, rounded to 4."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = rows.withColumn("relevance_score", F.round(cosine(F.col(vector), q), 4))
    return out.orderBy(F.desc_nulls_last("relevance_score"), *[c for c in rows.columns if c != vector])


def pinned_first(hits: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """(qid, id, pinned, score): all pinned of the bank (id, text, pinned), then the nearest others up to k, ties by text."""
    rows = hits.join(bank, "id")
    w = Window.partitionBy("qid").orderBy(F.desc("pinned"), F.desc("score"), "text", "id")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("pinned") | (F.col("rn") <= k)).select("qid", "id", "pinned", "score")


def tables_of(hits: DataFrame, edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(qid, tab): tables of the hits and of the nodes that the hits are linked to. owner: (id, tab)."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("id", "other")
    near = hits.select("qid", "id").join(both, "id").select("qid", F.col("other").alias("id"))
    return hits.select("qid", "id").union(near).join(owner, "id").select("qid", "tab").distinct()


def content_id(*parts: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def replace_slices(bank: DataFrame, fresh: DataFrame, by: tuple[str, ...] = ("db", "stage")) -> DataFrame:
    """The bank with every (db, stage) slice that fresh has replaced by fresh's rows; one row per content id."""
    kept = bank.join(fresh.select(*by).distinct(), list(by), "left_anti")
    return kept.unionByName(first_per_key(fresh, ["id"], [F.asc_nulls_last(c) for c in sorted(fresh.columns)]))


#: Vectors that centroids are trained on (about; twice as many at most), rounds of training, and lists at most.
SAMPLE, ROUNDS, MOST_LISTS = 1 << 16, 12, 4096


def unit_rows(column: pd.Series) -> np.ndarray:
    """Unit vectors as float rows; null, zero and non-finite ones are zero."""
    size = max((len(x) for x in column if x is not None), default=0)
    rows = np.array([x if x is not None and len(x) == size else [0.0] * size for x in column], float).reshape(len(column), size)
    rows[~np.isfinite(rows).all(1)] = 0
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def train_centroids(vectors: DataFrame, lists: int | None = None, seed: int = 7) -> np.ndarray:
    """Centroids of spherical k-means for vectors (id, v): as many as the root of the vectors, MOST_LISTS at most, unless `lists` says.
    They are trained on a sample by id of about SAMPLE vectors, whatever the table's size; every vector is indexed."""
    n = vectors.count()
    share = min(1.0, SAMPLE / max(n, 1))
    picked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * SAMPLE).toPandas()
    x = unit_rows(picked["v"])
    x = x[(x != 0).any(1)]
    k = max(1, min(lists or round(n**0.5), MOST_LISTS, len(x)))
    if not len(x):
        return np.zeros((1, x.shape[1] if x.ndim == 2 else 0))
    order = np.lexsort(x.T)  # the same centroids in whatever order the sample comes
    c = x[order][np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(length > 0, sums / np.where(length > 0, length, 1), c)
    return c


def inverted_lists(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, list, code, scale): each vector under its nearest centroid, a byte for each dimension. Vectors without
    direction are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = unit_rows(b["v"])
            sound = (x != 0).any(1) if x.shape[1] == centres.shape[1] else np.zeros(len(b), bool)
            x, ids = x[sound], b["id"][sound]
            scale = np.abs(x).max(1, initial=1e-30) / 127
            code = np.rint(x / scale[:, None]).astype(np.int8)
            yield pd.DataFrame({"id": ids, "list": (x @ centres.T).argmax(1).astype(np.int32) if len(x) else np.zeros(0, np.int32), "code": [r.tobytes() for r in code], "scale": scale})

    return vectors.select("id", F.col("v").cast("array<double>").alias("v")).mapInPandas(run, f"id {dict(vectors.dtypes)['id']}, list int, code binary, scale double")


def probed(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(qid, q, list): each query with its nearest `probes` lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = unit_rows(b["q"])
            b, x = (b[(x != 0).any(1)], x[(x != 0).any(1)]) if x.shape[1] == centres.shape[1] else (b[:0], x[:0])
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes] if len(x) else np.zeros((0, 1), int)
            yield pd.DataFrame({"qid": b["qid"], "q": list(x), "lists": list(near.astype(np.int32))})

    found = queries.select("qid", F.col("q").cast("array<double>").alias("q")).mapInPandas(run, f"qid {dict(queries.dtypes)['qid']}, q array<double>, lists array<int>")
    return found.select("qid", "q", F.explode("lists").alias("list"))


def candidates(queries: DataFrame, vectors: DataFrame, most: int, *, lists: int | None = None, probes: int = 8, seed: int = 7) -> DataFrame:
    """(qid, id): for each query the `most` vectors that score best by their codes in the lists that it probes. A list
    with many vectors or queries is dealt to blocks, as `cosine_top_k` does with all of them."""
    centres = train_centroids(vectors, lists, seed)
    coded, asked = inverted_lists(vectors, centres), probed(queries, centres, probes)
    blocks = lambda df, n, name: df.groupBy("list").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    sizes = blocks(coded, BLOCK_ROWS, "bs").join(blocks(asked, QUERY_ROWS, "as"), "list")  # MOST_LISTS rows at most
    number = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(F.broadcast(sizes), "list").select("list", "qid", "q", number("qid", "as").alias("a"), "bs").withColumn("b", each("bs"))
    right = coded.join(F.broadcast(sizes), "list").select("list", "id", "code", "scale", number("id", "bs").alias("b"), "as").withColumn("a", each("as"))

    def best(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if own.empty or near.empty:
            return pd.DataFrame({"qid": own["qid"][:0], "id": near["id"][:0], "score": np.zeros(0)})
        q, ids, found = np.stack(own["q"].to_numpy()).astype(np.float32), near["id"].to_numpy(), []
        v = np.frombuffer(b"".join(near["code"]), np.int8).reshape(len(near), -1).astype(np.float32) * near["scale"].to_numpy(np.float32)[:, None]
        for n in range(0, len(q), 256):
            scores = q[n : n + 256] @ v.T
            top = np.argpartition(-scores, most - 1, axis=1)[:, :most] if scores.shape[1] > most else np.tile(np.arange(scores.shape[1]), (len(scores), 1))
            at = np.repeat(np.arange(len(scores)), top.shape[1])
            found.append(pd.DataFrame({"qid": own["qid"].to_numpy()[n + at], "id": ids[top.ravel()], "score": scores[at, top.ravel()].astype(float)}))
        return pd.concat(found)

    out = f"qid {dict(queries.dtypes)['qid']}, id {dict(vectors.dtypes)['id']}, score double"
    pairs = left.groupBy("list", "a", "b").cogroup(right.groupBy("list", "a", "b")).applyInPandas(best, out)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("qid", "id")


def approximate_top_k(queries: DataFrame, vectors: DataFrame, k: int, *, lists: int | None = None, probes: int = 8, again: int = 5, seed: int = 7) -> DataFrame:
    """Like cosine_top_k, over an inverted index: of the lists of the nearest `probes` centroids the `again` * k best by codes
    of a byte a dimension are scored again exactly, so a query has that many exact pairs, however many vectors there are."""
    pairs = candidates(queries, vectors, again * k, lists=lists, probes=probes, seed=seed)
    scored = pairs.join(queries, "qid").join(vectors, "id").select("qid", "id", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def near_duplicate_gate(queries: DataFrame, bank: DataFrame, most: float = 0.92, *, lists: int | None = None, probes: int = 3, seed: int = 7) -> DataFrame:
    """(qid, fresh): whether no vector of the bank but the query's own comes as near as `most`, over an inverted index. What lies that
    near has the same nearest centroids but for ties, so few lists do; queries without direction are fresh."""
    top = approximate_top_k(queries, bank, 2, lists=lists, probes=probes, seed=seed).where(F.col("qid") != F.col("id"))
    top = top.groupBy("qid").agg(F.max("score").alias("score"))
    return queries.select("qid").join(top, "qid", "left").select("qid", (F.coalesce("score", F.lit(-1.0)) < most).alias("fresh"))
