"""A Merkle manifest of a dataset, and the folding of single leaves (operator 11).

Each row is a leaf. The leaves of a source, in order, form a tree: every three consecutive nodes become their
parent until one is left, the source's subroot; the subroots form such a tree again, whose root stands for
the dataset. A parent keeps a copy of its hash's state before each child's slot. To fold a leaf anew, the state before its
slot is resumed with the replacement and the siblings on its right; what is on its left is never hashed again.

Trees are built by blocks of 3^HEIGHT consecutive nodes, a group each, whose roots are the nodes of the next
round; a round is a job over a table that is 729 times smaller. On the way down each block root
learns its path (the siblings on both sides, level by level), and a block of leaves folds all of
them in one task that has the states of its own parents and one state for each level above.

Edge cases: a null value is `-`, so null and empty texts differ; leaves ascend by doc_id, null first, rows under one
id by their digest; a row without id is never tampered with; repeated rows are leaves each; one leaf is its own subroot,
one subroot is the root; an empty table has no rows; texts of any length are hashed in the JVM and don't reach the trees. Other
columns pass through `leaves`, and `prove` keeps none but those that its docstring names."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordering import running

from .common import crc32_sql, fresh, materialise

FAN, HEIGHT = 3, 6
WIDTH = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves that a range of the order has: at least and at most.
LEAST_RANGE, MOST_RANGE = 4096, 1 << 17


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values, each with its byte count before it."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in text]), 256)


def leaves(docs: DataFrame, name: str = "leaf", **instead: Column) -> DataFrame:
    """docs with the digest of FIELDS, of which some may be given instead."""
    return docs.withColumn(name, digest(*[instead.get(f, F.col(f)) for f in FIELDS]))


def parents(nodes: list[bytes]) -> tuple[list[list], list[bytes]]:
    """For each run of FAN nodes the hash's state before each slot, and the digest of the run."""
    kept, up = [], []
    for a in range(0, len(nodes), FAN):
        h, before = hashlib.sha256(), []
        for x in nodes[a : a + FAN]:
            before.append(h.copy())
            h.update(x)
        kept.append(before)
        up.append(h.hexdigest().encode())
    return kept, up


def ascend(nodes: list[bytes], height: int) -> tuple[list[list[bytes]], list[list[list]]]:
    """The nodes of each level from the leaves to the root, and the states of each level's parents."""
    levels, states = [nodes], []
    for _ in range(height):
        kept, up = parents(levels[-1])
        states.append(kept)
        levels.append(up)
    return levels, states


def siblings(levels: list[list[bytes]], i: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of node i and of its ancestors in their runs, level by level."""
    path = []
    for nodes in levels[:-1]:
        a = i - i % FAN
        path.append((b"".join(nodes[a:i]), b"".join(nodes[i + 1 : a + FAN])))
        i //= FAN
    return path


def fold(x: bytes, i: int, levels: list[list[bytes]], states: list[list[list]]) -> bytes:
    """The root with x in place of leaf i."""
    for nodes, kept in zip(levels, states):
        run, slot = divmod(i, FAN)
        h = kept[run][slot].copy()
        h.update(x)
        for right in nodes[i + 1 : run * FAN + FAN]:
            h.update(right)
        x, i = h.hexdigest().encode(), run
    return x


def ordered(group: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    """A block's rows in order, their digests, and the levels from them to the block's root."""
    group = group.sort_by("i")
    return group, [x.encode() for x in group.column("digest").to_pylist()], min(HEIGHT, group.column("levels")[0].as_py())


NODE = "tree long, i long, levels int, digest string"
STEP = "array<struct<left: string, right: string>>"
SPINE = f"tree long, i long, path {STEP}, subroot string, root string"


def block_roots(nodes: DataFrame) -> DataFrame:
    """The nodes of the next round: a block's root each."""

    def run(group: pa.Table) -> pa.Table:
        group, digests, height = ordered(group)
        top, first = ascend(digests, height)[0][-1][0].decode(), group.slice(0, 1)
        out = [first.column("tree")[0].as_py()], [first.column("i")[0].as_py() // WIDTH], [first.column("levels")[0].as_py() - height], [top]
        return pa.table(list(out), schema=pa.schema([("tree", pa.int64()), ("i", pa.int64()), ("levels", pa.int32()), ("digest", pa.string())]))

    return nodes.select("tree", "i", "levels", "digest", block()).groupBy("tree", "block").applyInArrow(run, NODE)


def block() -> Column:
    return F.floor(F.col("i") / WIDTH).cast("long").alias("block")


def met(nodes: DataFrame, spine: DataFrame):
    """Each block of nodes with the path of its root."""
    return nodes.withColumn("block", block()).groupBy("tree", "block").cogroup(spine.withColumnRenamed("i", "block").groupBy("tree", "block"))


def spines(nodes: DataFrame, most: int, finish) -> DataFrame:
    """(tree, i, path, subroot, root) for each node, of trees with up to `most` levels; finish gives it for their roots."""
    if most <= 0:
        return finish(nodes)
    above = spines(materialise(block_roots(nodes), "nodes"), most - HEIGHT, finish)

    def run(group: pa.Table, root: pa.Table) -> pa.Table:
        group, digests, height = ordered(group)
        levels, _ = ascend(digests, height)
        top = root.to_pylist()[0]
        paths = [[{"left": a.decode(), "right": b.decode()} for a, b in siblings(levels, k)] + top["path"] for k in range(len(digests))]
        same = [pa.array([top[c]] * len(digests), pa.string()) for c in ("subroot", "root")]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table([group.column("tree"), group.column("i"), pa.array(paths, kind), *same], names=["tree", "i", "path", "subroot", "root"])

    return materialise(met(nodes, above).applyInArrow(run, SPINE), "spines")


def height_of(n: Column | str) -> Column:
    """Levels from n nodes to one."""
    powers = F.array(*[F.lit(FAN**k).cast("long") for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < F.col(n) if isinstance(n, str) else p < n)).cast("int")


def prove(rows: DataFrame, group: str, order: list[str], leaf: str, changed: str, *, proofs: bool = False) -> DataFrame:
    """For each row: the columns of `order` and `leaf`, then subroot, root, proof_sha256 (of all siblings up to the root), folded_root
    (with the digest `changed` in the leaf's place) and verified; with `proofs` also proof, the siblings' digests. `group`
    names the column whose values have a tree each, ordered as `order` says."""
    spark = rows.sparkSession
    keep = [*dict.fromkeys([*order, leaf])]
    named = rows.select(*[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep)], F.col(f"`{group}`").alias("g"), F.col(f"`{leaf}`").alias("digest"), F.col(f"`{changed}`").alias("changed"))
    # Rows that are alike in all columns go to different ranges by their number.
    named = materialise(named.withColumn("row", F.monotonically_increasing_id()), "leaves")
    n, parts = named.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc_nulls_first("g"), *[F.asc_nulls_first(f"k{k}") for k in range(len(order))], F.asc("digest"), F.asc("changed"), F.asc("row")]
    counts = materialise(named.groupBy("g").agg(F.count("*").alias("n")), "sources")
    trees = running(counts, [F.asc_nulls_first("g")], {"tree": F.lit(1), "begin": F.col("n")})
    trees = materialise(trees.select("g", F.col("tree").cast("long").alias("tree"), F.col("begin").cast("long").alias("begin"), height_of("n").alias("levels")), "trees")
    most, sources = trees.agg(F.coalesce(F.max("levels"), F.lit(0)), F.count("*")).first()
    placed = running(named, by, {"at": F.lit(1)}, min(max(n // parts, LEAST_RANGE), MOST_RANGE)).drop("row")
    at = placed.alias("d").join(trees.alias("t"), F.col("d.g").eqNullSafe(F.col("t.g"))).select("d.*", "tree", "levels", (F.col("at") - F.col("begin")).cast("long").alias("i"))
    at = materialise(at.drop("g", "at"), "leaves")

    def finish(roots: DataFrame) -> DataFrame:
        tops = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), height_of(F.lit(sources).cast("long")).alias("levels"), "digest")
        above = spines(tops, len([k for k in range(40) if FAN**k < sources]), lambda one: one.select("tree", "i", F.array().cast(STEP).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")))
        return above.select(F.col("i").alias("tree"), "path", "root").join(roots.select("tree", F.col("digest").alias("subroot")), "tree").select("tree", F.lit(0).cast("long").alias("i"), "path", "subroot", "root")

    top = spines(materialise(block_roots(at), "nodes"), most - HEIGHT, finish)
    kinds = [named.schema[f"k{k}"].dataType.simpleString() for k in range(len(keep))]
    out = ", ".join([*(f"k{k} {t}" for k, t in enumerate(kinds)), "subroot string, root string, proof_sha256 string, folded_root string", *["proof array<string>"] * proofs])

    def run(group: pa.Table, root: pa.Table) -> pa.Table:
        group, digests, height = ordered(group)
        levels, states = ascend(digests, height)
        top = root.to_pylist()[0]
        # Above the block all its leaves share their siblings, and so one state before the slot of each level.
        above = [(hashlib.sha256(step["left"].encode()), step["right"].encode()) for step in top["path"]]
        shared = b"".join((step["left"] + step["right"]).encode() for step in top["path"])
        proof, folded, full = [], [], []
        for k, x in enumerate(group.column("changed").to_pylist()):
            x = fold(x.encode(), k, levels, states)
            for state, right in above:
                h = state.copy()
                h.update(x)
                h.update(right)
                x = h.hexdigest().encode()
            folded.append(x.decode())
            path = b"".join(a + b for a, b in siblings(levels, k)) + shared
            proof.append(hashlib.sha256(path).hexdigest())
            if proofs:
                full.append([path[a : a + 64].decode() for a in range(0, len(path), 64)])
        own = [group.column(f"k{k}") for k in range(len(keep))]
        own += [pa.array([top[c]] * len(folded), pa.string()) for c in ("subroot", "root")] + [pa.array(proof, pa.string()), pa.array(folded, pa.string())]
        return pa.table(own + [pa.array(full, pa.list_(pa.string()))] * proofs, names=[f.split()[0] for f in out.split(", ")])

    told = met(at, top).applyInArrow(run, out)
    return told.select(*[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)], "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *["proof"] * proofs)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text without line ends where 2 divides the crc32 of the id's digits."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    leaf, changed = fresh(docs, "leaf"), fresh(docs, "changed")
    both = leaves(leaves(docs, leaf), changed, text=tampered(F.col("doc_id"), F.col("text")))
    return prove(both.select("doc_id", "source", leaf, changed), "source", ["doc_id"], leaf, changed)


def _tree(name: str, nodes: str) -> str:
    """DuckDB for the nodes of all levels (level, tree, i, digest, n) over nodes (tree, i, digest); n: nodes of the level."""
    return f"""{name} as (
  select 0 as level, tree, i, digest, count(*) over (partition by tree) as n from {nodes}
  union all
  select level + 1, tree, i // 3, sha256(string_agg(digest, '' order by i)), (n + 2) // 3 from {name} where n > 1 group by level, tree, i // 3, n)"""


def _folded(name: str, start: str, tree: str) -> str:
    """DuckDB for the leaves of start (id, tree, i, x, proof) on their way up the tree."""
    return f"""{name} as (
  select id, 0 as level, tree, i, x, proof from {start}
  union all
  select f.id, f.level + 1, f.tree, f.i // 3, sha256(string_agg(case when t.i = f.i then f.x else t.digest end, '' order by t.i)),
    f.proof || coalesce(string_agg(t.digest, '' order by t.i) filter (where t.i <> f.i), '')
  from {name} f join {tree} t on t.level = f.level and t.tree = f.tree and t.i // 3 = f.i // 3 where t.n > 1 group by f.id, f.level, f.tree, f.i, f.x, f.proof)"""


def _field(c: str) -> str:
    return f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(text if f == 'text' else f) for f in FIELDS)})"


OP11_SQL = f"""
with recursive hashed as materialized (
  select doc_id, source, {_leaf('text')} as leaf, {_leaf("(case when changes then replace(text, chr(10), '') else text end)")} as changed
  from (select *, coalesce({crc32_sql('doc_id::varchar')} % 2 = 0, false) as changes from documents)),
placed as materialized (
  select *, row_number() over () as id, dense_rank() over (order by source nulls first) - 1 as tree,
    row_number() over (partition by source order by doc_id nulls first, leaf, changed) - 1 as i from hashed),
{_tree('nodes', '(select tree, i, leaf as digest from placed)')},
subroots as materialized (select tree, digest from nodes where n = 1),
{_tree('tops', '(select 0 as tree, tree as i, digest from subroots)')},
{_folded('below', "(select id, tree, i, changed as x, '' as proof from placed)", 'nodes')},
reached as materialized (select * from below qualify row_number() over (partition by id order by level desc) = 1),
{_folded('above', '(select id, 0 as tree, tree as i, x, proof from reached)', 'tops')},
ended as materialized (select * from above qualify row_number() over (partition by id order by level desc) = 1)
select doc_id, leaf, s.digest as subroot, r.digest as root, sha256(e.proof) as proof_sha256, e.x as folded_root, e.x = r.digest as verified
from placed p join subroots s using (tree) join ended e using (id), (select digest from tops where n = 1) r
"""
