"""Embedding near-dedup by PCA-ordered tiled comparison (operator 3).

Unit vectors are rotated to their principal axes, found from sums that the executors make. In the order of the
first component they are cut into strips, and a task compares two strips; two unit vectors at cosine t lie within
sqrt(2 - 2t) of each other, so only strips whose ranges come that close meet. In a task either strip is cut into tiles
by halving it across its widest axis, and tiles whose boxes lie further apart are passed over. In a pair of tiles the leading
components are multiplied first; what remains is at most the product of the suffix norms, and pairs whose
bound stays below the threshold stop there: all pairs at a time while many are left, then the survivors alone. What reaches the
threshold is compared in full, in double precision.

A row goes to a task for each strip that its own meets. Strips grow with the root of the number of rows (STRIP_ROWS to
MOST_VALUES numbers), so that where no axis separates anything copies grow with the root as well, until memory says no more.

A pair of strips yields link counts by vector and a spanning forest of its links, never the links
themselves; the forests join to components. Equal vectors are collapsed before.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing and are
components of their own; so are vectors of different lengths to each other, and vectors without vec_id; very large and very small
vectors are scaled by their largest component first; rows repeated under one vec_id
are one vector (with different embeddings: its smallest in array order); an empty table gives no rows."""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, materialise

THRESHOLD, LEAD, TILE_ROWS = 0.95, 8, 1024
#: Least rows and most numbers of a strip.
STRIP_ROWS, MOST_VALUES = 8192, 16 << 20
#: Pairs of tiles are multiplied block by block as matrices while more than one pair in so many can reach the threshold.
DENSE = 8


def sums(batches):
    """By length of the vectors: their number and the sums of their products."""
    total: dict[int, list] = {}
    for b in batches:
        for dim, x in matrices(b):
            have = total.setdefault(dim, [0, np.zeros((dim, dim)), np.zeros(dim)])
            have[0] += len(x)
            have[1] += x.T @ x
            have[2] += x.sum(0)
    rows = list(total.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in rows], pa.int32()), pa.array([h[0] for _, h in rows], pa.int64()), pa.array([h[1].tobytes() for _, h in rows], pa.binary()), pa.array([h[2].tobytes() for _, h in rows], pa.binary())], ["dim", "n", "products", "sums"]
    )


def matrices(b):
    v = b.column("v")
    dims = np.array(pc.list_value_length(v))
    for dim in np.unique(dims):
        x = v.filter(pa.array(dims == dim)).flatten().to_numpy().reshape(-1, dim)
        yield int(dim), units(x)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of what is very large or small are out of range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def add_sums(key, table):
    dim = key[0].as_py()
    products = sum(np.frombuffer(x, float) for x in table.column("products").to_pylist())
    mean = sum(np.frombuffer(x, float) for x in table.column("sums").to_pylist())
    return pa.table([pa.array([dim], pa.int32()), pa.array([sum(table.column("n").to_pylist())], pa.int64()), pa.array([products.tobytes()]), pa.array([mean.tobytes()])], ["dim", "n", "products", "sums"])


SUMS = "dim int, n long, products binary, sums binary"


def axes(rows) -> dict[int, np.ndarray]:
    """Principal axes by length of the vectors, most variance first."""
    found = {}
    for r in rows:
        d, n = r["dim"], r["n"]
        mean = np.frombuffer(r["sums"], float) / n
        cov = np.frombuffer(r["products"], float).reshape(d, d) / n - np.outer(mean, mean)
        found[d] = np.linalg.eigh(cov)[1][:, ::-1].copy()
    return found


def tiles_of(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of x in tiles of `most` at most, by halving across the widest axis."""
    done, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        own = x[rows, :LEAD]
        axis = int(np.argmax(own.var(axis=0)))
        order = rows[np.argsort(own[:, axis], kind="stable")]
        open_ += [order[: len(order) // 2], order[len(order) // 2 :]]
    return [t for t in done if len(t)]


def compare(left, right, threshold: float, same: bool):
    """(links by left row, links by right row, pairs that span them) of two strips given as (rotated, unit, weights)."""
    (a, ua, wa), (b, ub, wb) = left, right
    na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    parent = np.arange(len(a) + (0 if same else len(b)))
    shift = 0 if same else len(a)

    def root(rows):
        at = parent[rows]
        while (parent[at] != at).any():
            at = parent[at]
        parent[rows] = at
        return at

    def unite(i, j):
        """Hooks the roots of linked rows, the larger under the smaller, until each link has one root. A round looks at links
        between different roots only, each pair of roots once."""
        while len(i):
            p, q = root(i), root(j)
            j, i = np.divmod(np.unique((np.minimum(p, q) * len(parent) + np.maximum(p, q))[p != q]), len(parent))
            np.minimum.at(parent, i, j)
            hooked = np.unique(i)
            forest.append(np.stack([parent[hooked], hooked], 1))

    dim = a.shape[1] if len(a) else 0
    cuts = [min(LEAD, dim), *range(min(LEAD, dim) + 16, dim, 16)]
    cuts = cuts + [dim] * (cuts[-1] < dim)  # components that are multiplied by then
    rest = lambda x: [np.sqrt((x[:, c:] ** 2).sum(1)) for c in cuts]
    box = lambda x: (x[:, :LEAD].min(0), x[:, :LEAD].max(0))
    rows_of = [(t, a[t], box(a[t]), rest(a[t])) for t in tiles_of(a, TILE_ROWS)]
    cols_of = rows_of if same else [(t, b[t], box(b[t]), rest(b[t])) for t in tiles_of(b, TILE_ROWS)]
    forest, reach = [], 2 - 2 * threshold + 1e-9
    for m, (s, x, (low, high), rest_x) in enumerate(rows_of):
        for n, (t, y, (low2, high2), rest_y) in enumerate(cols_of):
            if same and n < m or (np.maximum(0, np.maximum(low - high2, low2 - high)) ** 2).sum() > reach:
                continue
            k, product = 0, x[:, : cuts[0]] @ y[:, : cuts[0]].T
            alive = product + np.outer(rest_x[0], rest_y[0]) >= threshold - 1e-9
            while DENSE * np.count_nonzero(alive) > alive.size and k + 1 < len(cuts):  # the next block of all pairs
                k += 1
                product += x[:, cuts[k - 1] : cuts[k]] @ y[:, cuts[k - 1] : cuts[k]].T
                alive = product + np.outer(rest_x[k], rest_y[k]) >= threshold - 1e-9
            if same and m == n:
                alive = np.triu(alive, 1)
            if DENSE * np.count_nonzero(alive) > alive.size:
                alive &= ua[s] @ ub[t].T >= threshold
                na[s] += alive @ wb[t]
                nb[t] += wa[s] @ alive
                i, j = np.nonzero(alive & (root(s)[:, None] != root(t + shift)))
                unite(s[i], t[j] + shift)
                continue
            i, j = np.nonzero(alive)
            for c, rx, ry in zip(cuts[k + 1 :], rest_x[k + 1 :], rest_y[k + 1 :]):  # further blocks, on the survivors
                if not len(i):
                    break
                stay = np.einsum("ij,ij->i", x[i, :c], y[j, :c]) + rx[i] * ry[j] >= threshold - 1e-9
                i, j = i[stay], j[stay]
            i, j = s[i], t[j]
            stay = np.einsum("ij,ij->i", ua[i], ub[j]) >= threshold
            i, j = i[stay], j[stay]
            np.add.at(na, i, wb[j])
            np.add.at(nb, j, wa[i])
            unite(i, j + shift)
    return na, nb, np.concatenate(forest) if forest else np.zeros((0, 2), np.int64)


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id) of every vector."""
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    sound = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), x).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    every = materialise(every, "vectors")
    # Equal vectors: one stands for all.
    classes = materialise(every.where("v is not null and vec_id is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "classes")
    stats = classes.select("v").mapInArrow(sums, SUMS).groupBy("dim").applyInArrow(add_sums, SUMS).collect()  # one matrix for each length
    turn, count = axes(stats), sum(r["n"] for r in stats)
    reach = sqrt(2 - 2 * threshold) + 1e-9

    def project(batches):
        for b in batches:
            dims = np.array(pc.list_value_length(b.column("v")))
            for dim, unit in matrices(b):
                own = b.filter(pa.array(dims == dim))
                yield pa.RecordBatch.from_arrays([own.column("rep"), own.column("copies"), own.column("dim"), own.column("v"), pa.array(unit @ turn[dim][:, 0])], ["rep", "copies", "dim", "v", "lead"])

    rows = classes.select("rep", "copies", "dim", "v").mapInArrow(project, "rep long, copies long, dim int, v array<double>, lead double")
    # Strips are neighbouring runs of the order by leading component; their ranges (a row for each) say which meet.
    widest = max((r["dim"] for r in stats), default=1)
    strip_rows = max(STRIP_ROWS, min(MOST_VALUES // widest, ceil(sqrt(count * STRIP_ROWS / 4))))
    rows = materialise(rows.repartitionByRange(max(1, 4 * ceil(count / strip_rows)), "dim", "lead", "rep").withColumn("run", F.spark_partition_id()), "runs")
    runs = rows.groupBy("dim", "run").agg(F.min("lead").alias("low"), F.max("lead").alias("high"), F.count("*").alias("n"))
    before = Window.partitionBy("dim").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialise(runs.withColumn("tile", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / strip_rows).cast("int")), "strips")
    strips = runs.groupBy("dim", "tile").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = rows.join(runs.select("dim", "run", "tile"), ["dim", "run"])
    other = strips.select("dim", F.col("tile").alias("with_tile"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meets = strips.join(other, "dim").where((F.col("low2") <= F.col("high") + reach) & (F.col("low") <= F.col("high2") + reach))
    meets = meets.groupBy("dim", "tile").agg(F.collect_set("with_tile").alias("others"))
    dealt = rows.join(meets, ["dim", "tile"]).select("rep", "copies", "dim", "v", "tile", F.explode("others").alias("o")).select("rep", "copies", "dim", "v", "tile", F.least("tile", "o").alias("first"), F.greatest("tile", "o").alias("second"))

    def run(key, t):
        dim, first, second = (k.as_py() for k in key)
        t = t.sort_by("rep")
        tile, ids, copies = t.column("tile").to_numpy(), t.column("rep").to_numpy(), t.column("copies").to_numpy()
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        unit = units(v)
        rotated = unit @ turn[dim]
        a, b = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
        side = lambda at: (rotated[at], unit[at], copies[at])
        na, nb, forest = compare(side(a), side(b), threshold, first == second)
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, a, na)
        np.add.at(n, b, nb)
        linked = np.flatnonzero(n)
        place = a if first == second else np.concatenate([a, b])  # what the forest's numbers stand for
        one, two = ids[place[forest[:, 0]]], ids[place[forest[:, 1]]]
        return pa.table(
            [pa.array([*ids[linked], *one], pa.int64()), pa.array([*[None] * len(linked), *two], pa.int64()), pa.array([*n[linked], *[0] * len(forest)], pa.int64())], ["a", "b", "n"]
        )

    found = materialise(dealt.groupBy("dim", "first", "second").applyInArrow(run, "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b is not null").select("a", "b"))
    named = classes.join(counts, F.col("rep") == F.col("a"), "left").join(parts, F.col("rep") == F.col("id"), "left")
    named = named.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return every.join(named, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    found = link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP3_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a, v b where a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from r group by a),
n as (select a as vec_id, count(*) as n from l group by a)
select c.vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, c.vec_id = component_id as kept from c left join n using (vec_id)
"""
