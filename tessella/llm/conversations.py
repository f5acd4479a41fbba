"""A trie of conversations by their prefixes (operator 13).

Each prefix of a conversation has a digest. A count-min sketch over the digests of all prefixes, of a bounded
size, is built by the tasks, merged cell by cell and sent to them again. It never counts too little, so a
prefix that it counts once belongs to one conversation alone, as do all longer ones: these tails are nodes whose figures are
known where they stand. Only prefixes that it counts more often are shuffled and grouped exactly; where cells
collide that is some more work and the same result, whatever the sketch's size.

A digest is a sum over the turns of SHA-256 halves of (place, role, text), so that running sums over ranges of an
order give it and a conversation may be of any length. What a node sums over its subtree is counted at the smallest member of each
node below it, and summed from the end of that conversation: no walk from depth to depth.

Edge cases: a null role or text is empty; turns under one number (or none, which come first) stand in the order of their
digests, repeated rows are turns each; rows without conv_id are left out; a conversation that keeps no turn
ends at the root; texts of any length are hashed in the JVM and left behind; an empty table has no nodes. Extra columns are
ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc32_sql, fresh, materialise
from .mixing import WORD

#: Rows of the sketch, cells of a row for each prefix, and cells of a row at least and at most (16 million bytes).
DEPTH, PER_PREFIX, LEAST_CELLS, MOST_CELLS = 3, 4, 1 << 12, 1 << 24
#: Cells that travel together, and ids of a node that are joined to one text.
CHUNK, JOINED = 1 << 12, 512
FAMILY, KEPT = 20, 4
LEAST_RANGE, MOST_RANGE = 4096, 1 << 17


def running_within(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, under each name, the sum over the rows before it that have its key. Rows are dealt by ranges of
    key and order; a key that goes over several ranges takes its sums of the earlier ones along."""
    parts, n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count()
    ranges = -(-n // min(max(n // parts, LEAST_RANGE), MOST_RANGE)) or 1
    at = fresh(df, "range")
    dealt = materialise(df.repartitionByRange(ranges, F.asc(key), *order).withColumn(at, F.spark_partition_id()), "dealt")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    scan = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    # Only the last key of a range can go on in the next, where it is the first.
    edges = dealt.groupBy(at).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    edge = dealt.alias("d").join(edges.alias("e"), at).where((F.col(f"d.{key}") == F.col("e.lo")) | (F.col(f"d.{key}") == F.col("e.hi")))
    edge = edge.groupBy(at, F.col(f"d.{key}").alias(key)).agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    carried = materialise(edge.select(at, key, *[scan(f"_{name}", Window.partitionBy(key).orderBy(at)).alias(f"_{name}") for name in sums]), "carried")
    own = Window.partitionBy(at, key).orderBy(*order)
    rows = dealt.withColumns({name: scan(c, own) for name, c in sums.items()}).join(carried, [at, key], "left")
    return rows.select(*df.columns, *[(F.col(name) + F.coalesce(f"_{name}", F.lit(0))).alias(name) for name in sums])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, turn_sha256, words, ends): the turns of each rebuilt conversation and, at depth 0, its beginning."""
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("turn_sha256"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = materialise(turns.where("conv_id is not null").withColumn("row", F.monotonically_increasing_id()), "turns")
    placed = running_within(turns, "conv_id", [F.asc_nulls_first("turn"), F.asc("turn_sha256"), F.asc("row")], {"pos": F.lit(1).cast("long")}).drop("row", "turn")
    placed = materialise(placed, "placed")
    own = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % KEPT).alias("h")
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("len")).select("conv_id", "len", own, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    convs = convs.join(lengths, "base", "left").withColumn("used", F.least("h", F.coalesce("base_len", F.lit(0))))
    convs = materialise(convs.withColumn("last", F.col("used") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "used", "last"), "conversations")
    end = (F.col("depth") == F.col("last")).alias("ends")
    root = convs.withColumn("depth", F.lit(0).cast("long")).select("conv_id", "depth", F.lit(None).cast("string").alias("turn_sha256"), F.lit(0).cast("long").alias("words"), end)
    first = placed.where((F.col("pos") < KEPT - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base").join(convs, "base").where("pos < used")
    first = first.withColumn("depth", F.col("pos") + 1).select("conv_id", "depth", "turn_sha256", "words", end)
    rest = placed.where(F.col("pos") >= F.crc32(F.col("conv_id").cast("string").cast("binary")) % KEPT).join(convs, "conv_id")
    rest = rest.withColumn("depth", F.col("used") + F.col("pos") - F.col("h") + 1).select("conv_id", "depth", "turn_sha256", "words", end)
    return root.unionByName(first).unionByName(rest)


def prefixes(turns: DataFrame) -> DataFrame:
    """turns of `rebuilt` with the digest of the prefix that each one ends, and of the one before (root: null)."""
    placed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("turn_sha256")), 256)
    half = lambda a: F.coalesce(F.conv(F.substring("placed", a, 15), 16, 10).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    rows = materialise(turns.withColumn("placed", placed).withColumns({"a": half(1), "b": half(16)}).drop("placed", "turn_sha256"), "rebuilt")
    rows = running_within(rows, "conv_id", [F.asc("depth")], {"before_a": F.col("a"), "before_b": F.col("b")})
    key = lambda depth, a, b: F.md5(F.concat_ws(":", depth.cast("string"), a.cast("string"), b.cast("string")))
    own = key(F.col("depth"), F.col("before_a") + F.col("a"), F.col("before_b") + F.col("b"))
    above = F.when(F.col("depth") > 0, key(F.col("depth") - 1, F.col("before_a"), F.col("before_b")))
    return materialise(rows.select("conv_id", "depth", "words", "ends", own.alias("key"), above.alias("above")), "prefixes")


def cells(column: pa.Array, width: int) -> np.ndarray:
    """The cell of each digest in each row of the sketch, from one hash: its halves step through the row."""
    h = column.to_numpy(zero_copy_only=False).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(r) * step) & np.uint64(width - 1) for r in range(DEPTH)]).astype(np.int64)


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """Counts of rows' keys, DEPTH rows of width cells that stop at 2. Tasks send the chunks that they touched."""

    def add(counts: np.ndarray, more: np.ndarray) -> np.ndarray:
        return np.minimum(counts + more, 2).astype(np.uint8)

    def count(batches):
        counts = np.zeros((DEPTH, width), np.uint8)
        for b in batches:
            for own, at in zip(counts, cells(b.column(0), width)):
                where, n = np.unique(at, return_counts=True)
                own[where] = add(own[where], np.minimum(n, 2))
        chunks = counts.reshape(-1, CHUNK)
        for k in np.flatnonzero(chunks.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunks[k].tobytes()], pa.binary())], ["chunk", "counts"])

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(raw, np.uint8)
                found[k] = add(found[k], own) if k in found else own
        for k, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    merged = rows.select(F.xxhash64("key")).mapInArrow(count, schema).repartition("chunk").mapInArrow(merge, schema)
    whole = np.zeros((DEPTH * width // CHUNK, CHUNK), np.uint8)
    for r in merged.toLocalIterator():  # DEPTH * MOST_CELLS bytes at most
        whole[r["chunk"]] = np.frombuffer(r["counts"], np.uint8)
    return whole.reshape(DEPTH, width)


def screened(rows: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """rows of `prefixes` with alone (the prefix is surely one conversation's) and above_alone (the one before is)."""
    width = LEAST_CELLS
    wanted = min(PER_PREFIX * rows.count(), most)
    while width < wanted:
        width *= 2
    shared, columns = rows.sparkSession.sparkContext.broadcast(sketch(rows, width)), rows.columns

    def run(batches):
        counts = shared.value
        for b in batches:
            own, above = [np.min([c[at] for c, at in zip(counts, cells(b.column(h), width))], axis=0) == 1 for h in ("h", "above_h")]
            above &= b.column("depth").to_numpy() > 0
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(own | above), pa.array(above)], [*columns, "alone", "above_alone"])

    hashed = rows.withColumns({"h": F.xxhash64("key"), "above_h": F.xxhash64("above")})
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), "alone boolean", "above_alone boolean"])
    return materialise(hashed.mapInArrow(run, schema), "screened", "alone")


def joined_sha256(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ids of each key, ascending, comma-joined. Ids meet by JOINED in texts, and a key's texts
    pass through one hash in order, none but the present one in memory."""
    ranked = running_within(materialise(rows, "ends"), "key", [F.asc("conv_id")], {"n": F.lit(1).cast("long")})
    chunk = F.floor(F.col("n") / JOINED).cast("long").alias("chunk")
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    texts = ranked.groupBy("key", chunk).agg(ids.alias("ids")).repartition("key").sortWithinPartitions("key", "chunk")

    def run(batches):
        at, h = None, None
        for b in batches:
            done = []
            for key, text in zip(b.column("key").to_pylist(), b.column("ids")):
                if key == at:
                    h.update(b",")
                else:
                    if h:
                        done.append((at, h.hexdigest()))
                    at, h = key, hashlib.sha256()
                h.update(text.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["key", "ends_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([h.hexdigest()])], ["key", "ends_sha256"])

    return texts.mapInArrow(run, "key string, ends_sha256 string")


def trie(conversations: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256, see op13's contract."""
    rows = screened(prefixes(rebuilt(conversations)), most_cells)
    tails, shared = rows.where("alone"), rows.where("not alone")
    nodes = shared.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.max("above").alias("above"))
    nodes = materialise(nodes, "nodes")
    first = tails.where("not above_alone and depth > 0")
    below = nodes.select("above").unionByName(first.select("above")).where("above is not null").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(below, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "nodes")

    # What a node adds to its ancestors stands at its smallest member; each member has it below its own prefixes.
    zero = F.lit(0).cast("long")
    own = nodes.select("conv_id", "depth", F.lit(None).cast("string").alias("key"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    own = own.where("leaf > 0 or saved > 0").unionByName(tails.where("ends").select("conv_id", "depth", F.lit(None).cast("string").alias("key"), (zero + 1).alias("leaf"), zero.alias("saved")))
    line = materialise(own.unionByName(shared.select("conv_id", "depth", "key", zero.alias("leaf"), zero.alias("saved"))), "line")
    line = running_within(line, "conv_id", [F.desc("depth"), F.asc_nulls_first("key")], {"n_leaves": F.col("leaf"), "saved_tokens": F.col("saved")})
    sums = line.where("key is not null").groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    ends = joined_sha256(shared.where("ends").select("key", "conv_id"))
    top = nodes.select(F.col("key").alias("above"), F.col("conv_id").alias("up"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    none = F.lit(hashlib.sha256().hexdigest())
    # A prefix whose parent was not shuffled has a parent of one member, its own conversation.
    parent = F.when(F.col("depth") > 0, F.coalesce("up", "conv_id")).alias("parent_conv_id")
    grouped = nodes.join(sums, "key").join(ends, "key", "left").join(top, "above", "left")
    grouped = grouped.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    local = first.join(top, "above", "left").select("conv_id", "depth", parent, "ends")
    local = local.unionByName(tails.where("above_alone or depth = 0").select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id"), "ends"))
    known = {"n_convs": zero + 1, "n_children": (~F.col("ends")).cast("long"), "n_leaves": zero + 1, "saved_tokens": zero}
    local = local.withColumns(known).withColumn("ends_sha256", F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none))
    return grouped.unionByName(local.select(*columns))


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = rf"""
with turns as materialized (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as sha,
    row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
convs as materialized (select conv_id, conv_id - conv_id % {FAMILY} as base, count(*) as len, {crc32_sql('conv_id::varchar')} % {KEPT} as h from turns group by conv_id),
placed as materialized (
  select c.conv_id, t.pos as d, t.sha, t.text from convs c join turns t on t.conv_id = c.base and t.pos <= c.h
  union all
  select c.conv_id, t.pos - c.h + least(c.h, coalesce(b.len, 0)), t.sha, t.text from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h left join convs b on b.conv_id = c.base),
members as materialized (
  select conv_id, 0 as d, '' as path, 0 as words, not exists (select 1 from placed p where p.conv_id = convs.conv_id) as ends from convs
  union all
  select conv_id, d, string_agg(sha, '') over (partition by conv_id order by d), len(regexp_extract_all(text, '{WORD}')), d = max(d) over (partition by conv_id) from placed),
nodes as materialized (
  select d, path, min(conv_id) as conv_id, count(*) as n, max(words) as words, left(path, greatest(64 * (d - 1), 0)::bigint) as above,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from members group by d, path),
below as (select d - 1 as d, above as path, count(*) as n_children from nodes where d > 0 group by all),
sums as (
  select n.d, n.path, count(*) filter (where b.n_children is null) as n_leaves, sum((u.n - 1) * u.words) as saved_tokens
  from nodes n join nodes u on starts_with(u.path, n.path) left join below b on b.d = u.d and b.path = u.path group by all)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(b.n_children, 0) as n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, n.ends_sha256
from nodes n join sums s using (d, path) left join below b using (d, path) left join nodes p on p.d = n.d - 1 and p.path = n.above
"""
