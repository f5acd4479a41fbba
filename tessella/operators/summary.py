"""Aggregates: roll-ups, profiles, distinct lists, nested summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import number
from tessella.operators.lineage import checkpointed
from tessella.operators.ordering import running


def joined_set(c: str, by: str = "; ") -> Column:
    """Sorted distinct values as one text."""
    return F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), by)


def how_many(df: DataFrame, entity: str, *, approximate: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct(entity) if approximate else F.countDistinct(entity)).alias("n"))


#: The sketch behind a bracket of the median errs by one in ACCURACY ranks; the bracket begins twice as wide on each side.
ACCURACY = 10_000
#: Values of a group that one task may hold, and brackets, a row a group, that are sent to all tasks; more are joined, and a hot group is split there.
IN_TASK, BROADCAST_GROUPS = 1 << 20, 100_000


def statistics(df: DataFrame, name: str, by: list[str] = [], *, approximate: bool = False, in_task: int = IN_TASK) -> DataFrame:
    """avg, sum, min, max and median by group. The exact median is selected by `medians` as soon as a group has more than `in_task`
    values, else a task gathers each group; the approximate one comes from a sketch of bounded size, with a relative error of one in ten
    thousand ranks."""
    x = number(F.col(name))
    stats = lambda c: [f(c).alias(n) for n, f in (("avg", F.avg), ("sum", F.sum), ("min", F.min), ("max", F.max))]
    grouped = df.groupBy(*by)
    if approximate:
        return grouped.agg(*stats(x), F.percentile_approx(x, 0.5, ACCURACY).alias("median"))
    if (grouped.agg(F.count(name).alias("__n")).agg(F.max("__n")).first()[0] or 0) <= in_task:
        return grouped.agg(*stats(x), F.median(x).alias("median"))
    g = "__group"
    rows = df.select(*by, x.alias(f"{g}_x"), (F.struct(*by) if by else F.struct(F.lit(0).alias("all"))).alias(g))
    # One pass for the others and the first bracket.
    found = rows.groupBy(g).agg(*stats(F.col(f"{g}_x")), *bracket(f"{g}_x", 2 / ACCURACY))
    if not by:  # no rows are one group too
        found = df.sparkSession.range(1).select(F.struct(F.lit(0).alias("all")).alias(g)).join(found, g, "left")
    found = checkpointed(found)
    middle = medians(rows.select(F.col(g).alias("g"), F.col(f"{g}_x").alias("x")), found.select(F.col(g).alias("g"), "n", "lo", "hi"))
    out = found.join(middle.withColumnRenamed("g", g), g, "left")
    return out.select(*[F.col(f"{g}.`{c}`").alias(c) for c in by], "avg", "sum", "min", "max", "median")


def bracket(x: str, margin: float) -> list[Column]:
    """n, lo, hi: the count and values about so far below and above the middle."""
    ends = F.percentile_approx(x, [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)], ACCURACY)
    return [F.count(x).alias("n"), F.get(ends, 0).alias("lo"), F.get(ends, 1).alias("hi")]


def medians(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """(g, median): exact medians of rows (g, x). Each group is narrowed to values about its middle, of which only the distinct ones
    are shuffled; what is below is counted, and running counts over ranges of the values find the middle ranks. So no task has
    a whole group. Groups whose bracket proves too narrow are looked at again with a wider one."""
    done, margin = [], 2 / ACCURACY
    brackets = checkpointed(brackets.where("n > 0"))
    while True:
        side = F.broadcast(brackets) if brackets.count() <= BROADCAST_GROUPS else brackets
        inside = rows.where("x is not null").join(side, "g").where("x <= hi")
        counts = inside.groupBy("g", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x"), "n").agg(F.count("*").alias("c"))
        counts = checkpointed(counts)
        below = counts.groupBy("g", "n").agg(F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("c"))), F.lit(0)).alias("below"), F.sum("c").alias("upto"))
        # 0-based ranks of the middle one or two
        fits = (F.col("below") <= F.floor((F.col("n") - 1) / 2)) & (F.col("upto") > F.floor(F.col("n") / 2))
        told = checkpointed(brackets.join(below.drop("n"), "g", "left").withColumn("fits", F.coalesce(fits, F.lit(False))))
        ranked = running(counts.where("x is not null"), [F.asc("g"), F.asc("x")], {"at": F.col("c")})
        begin = ranked.groupBy("g").agg(F.min("at").alias("begin"))
        placed = ranked.drop("n").join(begin, "g").join(told.where("fits").select("g", "n", "below"), "g").withColumn("first", F.col("at") - F.col("begin") + F.col("below"))
        holds = lambda rank: (F.col("first") <= rank) & (rank < F.col("first") + F.col("c"))
        low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
        picked = placed.where(holds(low) | holds(high)).groupBy("g").agg(((F.min("x") + F.max("x")) / 2).alias("median"))
        done.append(picked)
        wider = told.where("not fits").select("g")
        if margin >= 0.5 or wider.isEmpty():
            return reduce(DataFrame.unionByName, done)
        margin = min(0.5, margin * 16)
        brackets = checkpointed(rows.join(wider, "g", "left_semi").groupBy("g").agg(*bracket("x", margin)))


def share(p: Column) -> Column:
    return F.count_if(p) / F.count("*")


def having(df: DataFrame, by: list[str], entity: str, least: int) -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(entity).alias("n")).where(F.col("n") >= least)


def linked_partners(edges: DataFrame, anchor: str, partner: str, anchors: list[str]) -> DataFrame:
    """Partners linked to all anchors that are asked for."""
    wanted = sorted({a.lower() for a in anchors})
    hit = edges.where(F.lower(anchor).isin(wanted))
    return hit.groupBy(partner).agg(F.countDistinct(F.lower(anchor)).alias("n")).where(F.col("n") == len(wanted)).select(partner)


def intersection_summary(df: DataFrame, name: str, most: int = 50) -> DataFrame:
    """(n, names): how many names, and the first of them; only these are gathered."""
    names = df.select(name).where(F.col(name).isNotNull()).distinct()
    first = names.orderBy(name).limit(most).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("names"))
    return names.agg(F.count("*").alias("n")).crossJoin(F.broadcast(first))  # one row each


def text_rollup(df: DataFrame, by: list[str], texts: list[str], firsts: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[joined_set(c).alias(c) for c in texts], *[F.min(c).alias(c) for c in firsts])


def profile(df: DataFrame) -> DataFrame:
    """(column, n_distinct, longest, constant) of every column, in one aggregate."""
    counts = [F.struct(F.lit(c).alias("column"), F.countDistinct(c).alias("n_distinct"), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias("longest")) for c in df.columns]
    rows = df.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return rows.withColumn("constant", F.col("n_distinct") <= 1)


def answer_lists(df: DataFrame, columns: list[str], most: int = 150) -> DataFrame:
    """(column, n, values) of columns that have more than one value, fewer than there are rows, and `most`
    at most; only those are collected into lists."""
    n = df.agg(F.count("*").alias("__rows"), *[F.countDistinct(c).alias(c) for c in columns]).first()
    chosen = [c for c in columns if 1 < n[c] < n["__rows"] and n[c] <= most]
    if not chosen:
        return df.sparkSession.createDataFrame([], "column string, n long, values string")
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in chosen])).alias("x")).select("x.*").where("v is not null").distinct()
    return rows.groupBy("column").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("v")), "|").alias("values"))


def low_cardinality(df: DataFrame, most: int = 25, longest: int = 40) -> DataFrame:
    """(column, values) of text columns with few short values."""
    names = [c for c, t in df.dtypes if t == "string"]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in names])).alias("x")).select("x.*").where("v is not null").distinct()
    n = rows.groupBy("column").agg(F.count("*").alias("n"), F.max(F.length("v")).alias("longest")).where((F.col("n") <= most) & (F.col("longest") <= longest))
    return rows.join(n.select("column"), "column", "left_semi").groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("values"))


def token_frequency(df: DataFrame, name: str, *, by: str = "_", skip: int = 1, least_length: int = 3, band: tuple[int, int] = (5, 300), stop: tuple[str, ...] = (), form: str = "^[A-Z]+$") -> DataFrame:
    """(token, n): tokens of coded names but the first, of a form, within a band of document frequency."""
    tokens = F.array_distinct(F.filter(F.split(F.upper(name), by), lambda t, i: (i >= skip) & (F.length(t) >= least_length) & t.rlike(form)))
    rows = df.select(F.explode(tokens).alias("token")).where(~F.col("token").isin(*stop) if stop else F.lit(True))
    return rows.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n").between(*band))


def hierarchy_json(df: DataFrame, levels: list[str], leaf: str) -> DataFrame:
    """A JSON text per value of the first level: nested keys down to sorted distinct leaves."""
    rows = df.select(*levels, leaf).distinct().groupBy(*levels).agg(F.array_sort(F.collect_list(leaf)).alias("v"))
    for k in range(len(levels) - 1, 0, -1):
        entries = F.array_sort(F.collect_list(F.struct(F.col(levels[k]).alias("key"), F.col("v").alias("value"))))
        rows = rows.groupBy(*levels[:k]).agg(F.map_from_entries(entries).alias("v"))
    return rows.select(levels[0], F.to_json("v").alias("tree"))


def by_cardinality(df: DataFrame, columns: list[str]) -> list[str]:
    n = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    return sorted(columns, key=lambda c: (n[c], c))


def drop_null_rows(df: DataFrame, exempt: tuple[str, ...] = ("_xref", "xref_id", "xref_source", "icd11", "relevance_score")) -> DataFrame:
    """Rows without nulls, but all rows if there are none."""
    names = [c for c in df.columns if not c.endswith(exempt)]
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    some = df.agg(F.coalesce(F.bool_or(whole), F.lit(False)).alias("__some"))
    return df.crossJoin(F.broadcast(some)).where(~F.col("__some") | whole).drop("__some")  # one row


def drop_empty(df: DataFrame) -> DataFrame:
    """Without columns that are empty throughout, then without rows that are."""
    filled = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull() for c in df.columns}
    some = df.agg(*[F.coalesce(F.bool_or(p), F.lit(False)).alias(c) for c, p in filled.items()]).first()
    names = [c for c in df.columns if some[c]]
    out = df.select(*names)
    any_filled = F.lit(False)
    for c in names:
        any_filled = any_filled | filled[c]
    return out.where(any_filled)


def fill(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts trimmed and "" for null, floats 0.0 for null; ids and names untouched."""
    out = {}
    for c, t in df.dtypes:
        if c in keep or c.endswith(("_id", "_name")):
            continue
        if t == "string":
            out[c] = F.coalesce(F.trim(c), F.lit(""))
        elif t in ("double", "float"):
            out[c] = F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumns(out)
