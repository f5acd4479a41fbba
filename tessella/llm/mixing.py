"""Mixing sources to target weights (operator 1).

Tokens are summed per source, targets are filled up under a cap, and each document is emitted
floor(rate) times plus one more time with a probability equal to the rate's fraction. The draw is a
hash of the document's id and text and, where rows repeat, of its number among them, so that reruns agree and
rows without ids, or under one id, are drawn each.

Edge cases: a null text has size 0; a null id is an id like others; a null source is a source of its own, ranked
last; sources without tokens get target 0 and their documents are taken 0 times; an empty table gives an
empty table. Other columns pass through `mix` untouched, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.ordering import running

from .common import fresh, materialise

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights 1, 2, 3 repeat over the sources in code point order. A source stops at `most` times its
    size; filling all others in proportion to weight stops them in the order of capacity per weight,
    so running sums in that order give the water level."""
    s = running(sizes.select("source", "source_size"), [F.asc_nulls_last("source")], {"w": F.lit(1)})
    s = s.withColumn("w", (F.col("w") % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    s = running(s, [F.col("cap") / F.col("w"), F.asc_nulls_last("source")], {"filled": F.col("cap"), "closed_w": F.col("w")})
    sums = s.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w")).first()
    total, weights = sums["total"] or 0, sums["w"] or 0
    # The level once all earlier sources are full; the source is full too if its cap lies below that.
    s = s.withColumn("full", F.col("cap") * (weights - F.col("closed_w")) <= (total - F.col("filled")) * F.col("w"))
    level = s.where(~F.col("full")).agg(F.min(F.struct("filled", "closed_w")).alias("at")).first()["at"]
    share = (total - level["filled"]) * F.col("w") / (weights - level["closed_w"]) if level else F.lit(0.0)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key: the first 52 bits of an MD5."""
    hexes = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return F.conv(hexes, 16, 10).cast("double") / float(1 << 52)


def numbered(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows with their number, from 0, among those of equal key; which row gets which number is open. A key is
    numbered in its shares of the rows' partitions, so that one with many rows is no task's alone."""
    part, begin = fresh(rows, "part"), fresh(rows, "begin")
    dealt = materialise(rows.withColumn(part, F.spark_partition_id()), "repeated")
    shares = dealt.groupBy(*key, part).agg(F.count("*").alias(begin))
    before = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn(begin, F.coalesce(F.sum(begin).over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*key, part).orderBy(F.lit(0))) - 1
    same = [F.col(f"d.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in (*key, part)]
    joined = dealt.withColumn(name, own).alias("d").join(shares.alias("s"), same)
    return joined.select("d.*", F.col(f"s.`{begin}`").alias(begin)).withColumn(name, F.col(name) + F.col(begin)).drop(part, begin)


def copies(docs: DataFrame, seed: int = 0, most: int = MOST) -> DataFrame:
    """(row, size, source_size, target, n): each row of docs as a struct, and how often it is taken.

    Sizes and repeated rows come from one sum per (source, id, text). The table of sources is written first, so
    that Spark picks the join with it by its true size."""
    rows = docs.select(F.struct("*").alias("row"), "source", F.col("doc_id").cast("string").alias("id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"), size_of().alias("size"))
    key = ["source", "id", "h"]
    groups = materialise(rows.groupBy(*key).agg(F.sum("size").alias("size"), F.count("*").alias("n")), "texts")
    by_source = materialise(targets(groups.groupBy("source").agg(F.sum("size").alias("source_size")), most), "targets")
    rows, again = rows.withColumn("number", F.lit(0).cast("long")), groups.where("n > 1").select(*key)
    if not again.isEmpty():
        again = materialise(again, "again")
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"a.{k}")) for k in key]
        found = rows.alias("r").join(again.alias("a"), same, "left_semi").drop("number")
        rows = rows.alias("r").join(again.alias("a"), same, "left_anti").unionByName(numbered(found, key, "number").withColumn("number", F.col("number").cast("long")))
    joined = rows.alias("d").join(by_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    chance = draw(F.concat_ws(":", F.coalesce("id", F.lit("")), "h", F.col("number").cast("string")), seed)
    n = F.least(F.floor(rate) + (chance < rate - F.floor(rate)).cast("long"), F.lit(most))
    return joined.select("row", "size", "source_size", "target", n.cast("int").alias("n"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: the columns of docs, each row as often as it is taken."""
    return copies(docs, seed).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return copies(docs).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"))


OP1_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(text, '')) as h,
         row_number() over (partition by source, doc_id, text) - 1 as number from documents),
s0 as (select source, sum(size)::bigint as source_size from sized group by source),
s1 as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w, source_size * 3 as cap from s0),
-- A share each of what is left for the sources below their cap, again and again, until none is above it.
fill as (
  select 0 as turn, source, source_size, w, cap, false as is_full, sum(source_size) over () as total from s1),
turns as (
  with recursive t as (
    select 0 as turn, source, w, cap, false as is_full, total from fill
    union all
    select turn + 1, source, w, cap,
      is_full or cap <= (total - coalesce(sum(cap) filter (where is_full) over (partition by turn), 0)) * w / sum(w) filter (where not is_full) over (partition by turn),
      total from t where turn < (select count(*) from s1))
  select * from t),
last as (select * from turns where turn = (select count(*) from s1)),
s4 as (select source, case when is_full then cap::double else
         ((total - coalesce(sum(cap) filter (where is_full) over (), 0)) * w)::double / sum(w) filter (where not is_full) over () end as target from last),
d as (select doc_id, size, source_size, target,
         case when source_size > 0 then target / source_size else 0.0 end as rate,
         ('0x' || substr(md5('0:' || coalesce(doc_id::varchar, '') || ':' || h || ':' || number), 1, 13))::bigint::double / 4503599627370496.0 as u
      from sized join s4 on sized.source is not distinct from s4.source join s0 on s0.source is not distinct from s4.source)
select doc_id, size, source_size, target,
  (size * least(floor(rate) + (case when u < rate - floor(rate) then 1 else 0 end), 3))::bigint as taken from d
"""
