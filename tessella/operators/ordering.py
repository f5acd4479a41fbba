"""Orders, top-k, previews. Every order ends in all columns, so that results don't depend on the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import number, phase_ordinal
from tessella.operators.lineage import checkpointed
from tessella.sources.curate import first_per_key


def total(df: DataFrame, *first: Column) -> list[Column]:
    return [*first, *[F.asc_nulls_last(c) for c in df.columns]]


def category_place(c: Column, order: list[str]) -> Column:
    """Place in a list of categories, unlisted and null last."""
    table = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)])
    return F.coalesce(F.try_element_at(table, c), F.lit(len(order)))


def any_of_first(c: Column, terms: list[str]) -> Column:
    hit = reduce(lambda a, b: a | b, [F.lower(c).contains(t.lower()) for t in terms])
    return F.when(F.coalesce(hit, F.lit(False)), 0).otherwise(1)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*total(df, *order)).limit(k)


def score_value(df: DataFrame, name: str) -> Column:
    """What a column sorts by: a phase by its stage, others as numbers; what is none counts as -1."""
    return phase_ordinal(F.col(name)).cast("double") if name == "phase" else F.coalesce(number(F.col(name)), F.lit(-1.0))


def top_ids(df: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """The first k distinct keys, without regard to case, of the rows by score; k from 1 to 50."""
    k = min(max(k, 1), 50)
    best = first_per_key(df.where(F.trim(F.col(key).cast("string")) != "").withColumn("__k", F.lower(F.trim(F.col(key).cast("string")))), ["__k"], total(df, F.desc(score_value(df, score))))
    return best.orderBy(F.desc(score_value(df, score)), "__k").limit(k).drop("__k")


def positive_top(df: DataFrame, name: str, k: int = 25) -> DataFrame:
    return top(df.where(F.col(name) > 0), k, F.desc_nulls_last(name))


def entity_tier(columns: list[str], terms: list[str]) -> Column:
    """0 where a cell equals a term, 1 where one contains it, else 2."""
    cells = F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    low = [t.lower() for t in terms]
    equal = F.exists(cells, lambda x: x.isin(low))
    part = F.exists(cells, lambda x: reduce(lambda a, b: a | b, [x.contains(t) for t in low]))
    return F.when(equal, 0).when(part, 1).otherwise(2)


def approval_tier(c: Column) -> Column:
    """Approved 0, phase n max(1, 4 - n), preclinical 4, other 5, none 10."""
    s = F.lower(F.trim(c))
    n = F.regexp_extract(s, r"phase\D*(\d)", 1)
    return F.when(s.isNull() | (s == ""), 10).when(s.contains("approv"), 0).when(n != "", F.greatest(F.lit(1), 4 - n.try_cast("int"))).when(s.contains("preclin"), 4).otherwise(5)


def preview(df: DataFrame, n: int, longest: int = 200) -> DataFrame:
    cells = {c: F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("…"))).otherwise(F.col(c)) for c, t in df.dtypes if t == "string"}
    return df.limit(n).withColumns(cells)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], most: int = 1 << 17) -> DataFrame:
    """df with, under each name, the sum over the rows before it in a total order. Rows are dealt by ranges of
    the order, about `most` to a range; the sums of the ranges, a row for each, say where each one begins."""
    ranges = -(-df.count() // most)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if ranges <= 1:
        return df.withColumns({n: F.coalesce(F.sum(c).over(before(Window.orderBy(*order))), F.lit(0)) for n, c in sums.items()})
    dealt = checkpointed(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    begin = dealt.groupBy("__range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    begin = begin.select("__range", *[F.coalesce(F.sum(n).over(before(Window.orderBy("__range"))), F.lit(0)).alias(f"__{n}") for n in sums])
    own = before(Window.partitionBy("__range").orderBy(*order))
    dealt = dealt.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()}).join(begin, "__range")
    return dealt.select(*df.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in a total order of the whole table."""
    return running(df, order, {name: F.lit(1)}).withColumn(name, (F.col(name) + 1).cast("long"))


def handles(df: DataFrame, db: str, order: list[Column]) -> DataFrame:
    rows = placed(df, order, "handle")
    return rows.withColumn("handle", F.concat(F.lit(f"{db}:"), F.col("handle").cast("string")))


def within_budget(df: DataFrame, order: list[Column], n: int, budget: int) -> DataFrame:
    """The largest n / 2^i first rows whose JSON fits the budget, one at least. Looks at n rows."""
    w = Window.orderBy("__i")
    rows = df.orderBy(*order).limit(n).withColumn("__i", F.row_number().over(Window.orderBy(*order)))
    size = rows.withColumn("__size", F.sum(F.length(F.to_json(F.struct(*df.columns)))).over(w))
    halves = []
    while n >= 1:
        halves.append(n)
        n //= 2
    fits = size.agg(*[F.coalesce(F.max(F.when(F.col("__i") <= h, F.col("__size"))), F.lit(0)).alias(str(h)) for h in halves]).select(
        F.coalesce(*[F.when(F.col(str(h)) <= budget, h) for h in halves], F.lit(1)).alias("__keep")
    )
    return size.crossJoin(F.broadcast(fits)).where(F.col("__i") <= F.col("__keep")).drop("__i", "__size", "__keep")  # one row


def lexical_rescue(df: DataFrame, position: str, cut: int, question: str, stop: tuple[str, ...] = (), most: int = 10) -> DataFrame:
    """Rows beyond the cut that share most words with the question, then by position."""
    import re

    words = sorted({w for w in re.findall("[a-z]+", question.lower()) if len(w) > 3} - set(stop))
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns if c != position]))
    overlap = F.size(F.array_intersect(F.regexp_extract_all(text, F.lit("([a-z]+)"), F.lit(1)), F.array(*[F.lit(w) for w in words]))) if words else F.lit(0)
    return df.where(F.col(position) > cut).withColumn("overlap", overlap).where("overlap > 0").orderBy(F.desc("overlap"), position).limit(most)


def row_limit(text: str, default: int = 25, most: int = 200) -> int:
    """N of "top N" or "first N" in an order, within bounds."""
    import re

    m = re.search(r"\b(?:top|first)\s+(\d+)", text.lower())
    return min(max(int(m[1]), 1), most) if m else default
