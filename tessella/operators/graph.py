"""Hops over typed edges and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.keyed import norm_key
from tessella.operators.lineage import checkpointed
from tessella.operators.ordering import score_value, top_ids, total
from tessella.sources.curate import first_per_key


def neighbours(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(root, node, hop, kind) within depth hops of (root): each node once, with the least type among the edges
    that reach it first. edges: (a, b, kind), walked both ways."""
    both = edges.select("a", "b", "kind").union(edges.select("b", "a", "kind")).toDF("node", "next", "kind")
    seen = start.select("root", F.col("root").alias("node"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("kind"))
    last = seen
    for hop in range(1, depth + 1):
        reached = last.select("root", "node").join(both, "node").groupBy("root", F.col("next").alias("node")).agg(F.min("kind").alias("kind"))
        last = checkpointed(reached.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(hop).alias("hop"), "kind"))
        seen = seen.union(last)
    return seen.where("hop > 0")


def typed_edges(records: DataFrame, by: str, table: str, node: str) -> DataFrame:
    """Edges between records of different tables that share a key name or a concept."""
    a = records.select(F.col(by), F.col(table).alias("ta"), F.col(node).alias("a"))
    b = records.select(F.col(by), F.col(table).alias("tb"), F.col(node).alias("b"))
    return a.join(b, by).where((F.col("ta") != F.col("tb")) & (F.col("a") < F.col("b"))).select("a", "b", F.col(by).alias("kind")).distinct()


def typed_hubs(records: DataFrame, by: str, table: str, node: str) -> DataFrame:
    """(hub, tab, node): what `typed_edges` links, as the membership of each record in its key's hub. One row for each distinct record,
    where the edges of a key with m records are up to m squared."""
    return records.where(F.col(by).isNotNull()).select(F.col(by).alias("hub"), F.col(table).alias("tab"), F.col(node).alias("node")).where("tab is not null and node is not null").distinct()


def hub_neighbours(hubs: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(root, node, hop, kind) as `neighbours` gives it over the edges of the same records, without those edges: a hop goes from
    a node to its hubs and from each hub to the members of other tables. The nodes by which a root comes to
    a hub are summed to the tables that they have, one or several, before its members are looked up."""
    seen = start.select("root", F.col("root").alias("node"), F.lit(0).alias("hop"), F.lit(None).cast(hubs.schema["hub"].dataType).alias("kind"))
    last = seen
    for hop in range(1, depth + 1):
        at = last.select("root", "node").join(hubs, "node").groupBy("root", "hub").agg(F.min("tab").alias("one"), F.max("tab").alias("other"))
        members = at.join(hubs, "hub").where((F.col("one") != F.col("other")) | (F.col("tab") != F.col("one")))
        reached = members.groupBy("root", "node").agg(F.min("hub").alias("kind"))
        last = checkpointed(reached.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(hop).alias("hop"), "kind"))
        seen = seen.union(last)
    return seen.where("hop > 0")


def descendants(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, node, depth): the whole closure below each root, itself at depth 0; cycles end where a node was seen."""
    seen = start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    last, d = seen, 0
    while True:
        d += 1
        below = last.select("root", "node").join(edges.select(F.col("parent").alias("node"), "child"), "node").select("root", F.col("child").alias("node")).distinct()
        last = checkpointed(below.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if last.isEmpty():
            return seen
        seen = seen.union(last)
        if d % 10 == 0:  # a deep closure is one table again, not a union of each depth
            seen = checkpointed(seen)


def children(edges: DataFrame, names: list[str], *, end: str = "parent") -> DataFrame:
    """The other ends of the edges whose parent (or child) is named."""
    other = "child" if end == "parent" else "parent"
    return edges.where(F.lower(F.col(f"{end}_name")).isin([n.lower() for n in names])).select(f"{other}_id", f"{other}_name").distinct()


def expand(source: DataFrame, edges: DataFrame, from_key: str, to_key: str, *, source_score: str, edge_score: str, top_k: int = 25, most: int = 1000) -> DataFrame:
    """Edges of the top source ids, best first."""
    ids = top_ids(source, from_key, source_score, top_k).select(norm_key(F.col(from_key)).alias("__k")).distinct()
    rows = edges.withColumn("__k", norm_key(F.col(from_key))).join(ids, "__k", "left_semi").drop("__k")
    return rows.orderBy(*total(rows, F.desc(score_value(rows, edge_score)))).limit(most)


class Edges:
    """Edge tables by the types of their ends: (from, to) -> (table, from key, to key)."""

    def __init__(self, tables: dict[tuple[str, str], tuple[DataFrame, str, str]]):
        self.tables = tables

    def of(self, a: str, b: str) -> tuple[DataFrame, str, str]:
        if (a, b) in self.tables:
            return self.tables[a, b]
        if (b, a) in self.tables:
            table, from_key, to_key = self.tables[b, a]
            return table, to_key, from_key
        raise KeyError(f"no edges from {a} to {b}; there are {sorted(self.tables)}")

    def path(self, *types: str) -> list[tuple[DataFrame, str, str]]:
        return [self.of(a, b) for a, b in zip(types, types[1:])]


def traverse(start: DataFrame, hops: list[tuple[DataFrame, str, str]], *, score: str, top_k: int = 25, name: str | None = None) -> DataFrame:
    """From start ids over one or two hops (edges, from, to); one row per final id, the best. Rows without an id
    are told apart by name, if one is given; rows with neither go."""
    rows = start
    for edges, a, b in hops:
        rows = expand(rows, edges, a, b, source_score=score, edge_score=score, top_k=top_k)
    key = norm_key(F.col(hops[-1][2]))
    if name and name in rows.columns:
        key = F.coalesce(F.concat(F.lit("id:"), key), F.concat(F.lit("name:"), norm_key(F.col(name))))
    kept = rows.where(key.isNotNull()).withColumn("__k", key)
    return first_per_key(kept, ["__k"], total(rows, F.desc(score_value(rows, score)))).drop("__k")


def evidence(rows: DataFrame, a: tuple[str, object], b: tuple[str, object], source: tuple[str, str] | None = None, page: int = 25) -> DataFrame:
    """Rows between two nodes, a page of 1 to 200, with the total beside them."""
    hit = rows.where((F.col(a[0]) == a[1]) & (F.col(b[0]) == b[1]))
    hit = hit.where(F.lower(F.col(source[0])) == source[1].lower()) if source else hit
    total_rows = hit.agg(F.count("*").alias("total"))
    return hit.crossJoin(F.broadcast(total_rows)).orderBy(*total(hit)).limit(min(max(page, 1), 200))  # one row
