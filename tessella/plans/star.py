"""Runs a star plan: every table is filtered by every filter it answers to, tables join along their parents,
and the result is projected, ranked and deduplicated in one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.functions import predicates
from tessella.functions.predicates import Filters, values_of
from tessella.operators.lineage import stored
from tessella.operators.ordering import any_of_first, category_place

from .spec import ExplosionError, MissingJoinError, SortKey, StarPlan, guard_filters

Catalog = dict[str, DataFrame]


@dataclass
class QueryResult:
    rows: DataFrame
    funnel: DataFrame | None = None  # per table and filter: rows before and after, from one pass over each table
    joins: DataFrame | None = None  # per join: the table, rows before and after, from the histograms of its keys or observed


def declared(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The declared columns that the table has, in declared order."""
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def join_keys(plan: StarPlan, parent: str, child: str, have: set[str], child_df: DataFrame) -> list[tuple[str, str]]:
    edge = plan.edge(parent, child)
    if edge:
        return list(zip(edge.left_on, edge.right_on))
    if plan.strict:
        raise MissingJoinError(f"{parent} and {child} have no join columns")
    shared = sorted(have & set(child_df.columns))
    if not shared:
        raise MissingJoinError(f"{parent} and {child} share no column")
    return [(c, c) for c in shared]


def attach(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str) -> DataFrame:
    """An equi-join that keeps one copy of each column name, the left one's."""
    taken = set(left.columns)
    renamed = right.select(*[F.col(r).alias(f"__k{i}") for i, (_, r) in enumerate(keys)], *[F.col(c) for c in right.columns if c not in taken])
    on = reduce(lambda a, b: a & b, [F.col(l) == F.col(f"__k{i}") for i, (l, _) in enumerate(keys)])
    return left.join(renamed, on, how).drop(*[f"__k{i}" for i in range(len(keys))])


def estimated_rows(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """(left_rows, right_rows, join_rows) of an equi-join, from the two key histograms and without joining."""
    ls, rs = [l for l, _ in keys], [r for _, r in keys]
    a = left.groupBy(*ls).agg(F.count("*").alias("__nl"))
    b = right.groupBy(*rs).agg(F.count("*").alias("__nr"))
    both = attach(a, b, keys, "inner").agg(F.coalesce(F.sum(F.col("__nl") * F.col("__nr")), F.lit(0)).alias("join_rows"))
    one = a.agg(F.coalesce(F.sum("__nl"), F.lit(0)).alias("left_rows")).crossJoin(F.broadcast(b.agg(F.coalesce(F.sum("__nr"), F.lit(0)).alias("right_rows"))))
    return one.crossJoin(F.broadcast(both))  # one row each


def join_step(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str) -> DataFrame:
    """(rows_before, rows_after) of a join, counted without joining rows."""
    ls, rs = [l for l, _ in keys], [r for _, r in keys]
    a, b = left.groupBy(*ls).agg(F.count("*").alias("__nl")), right.groupBy(*rs).agg(F.count("*").alias("__nr"))
    both = attach(a, b, keys, "left")
    after = F.col("__nl") * F.coalesce("__nr", F.lit(1 if how == "left" else 0))
    return both.agg(F.coalesce(F.sum("__nl"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum(after), F.lit(0)).alias("rows_after"))


def counted(df: DataFrame, marks: list[Observation]) -> DataFrame:
    """df, whose rows the run that reads it will count."""
    marks.append(Observation())
    return df.observe(marks[-1], F.count(F.lit(1)).alias("n"))


def observed_joins(spark: SparkSession, tables: list[str], marks: list[Observation]) -> DataFrame:
    """(step, table, rows_before, rows_after) from the marks of the root and of each join, once their rows have been run."""
    n = [m.get["n"] for m in marks]
    return spark.createDataFrame([(i + 1, t, n[i], n[i + 1]) for i, t in enumerate(tables)], "step int, table string, rows_before long, rows_after long")


#: The most rows that a join may give, unless its sides have more together, and the most for each row of its left side.
MOST_ROWS, MOST_FACTOR = 10_000_000, 100_000


def guard_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], most_factor: float = MOST_FACTOR, most_rows: int = MOST_ROWS) -> int:
    """The rows of the join, from the histograms of its keys; an error beyond the limits. A join that gives no more rows than it reads
    is no explosion, however large its tables are."""
    n = estimated_rows(left, right, keys).first()
    if n["join_rows"] > max(most_rows, n["left_rows"] + n["right_rows"]) or n["join_rows"] > most_factor * max(1, n["left_rows"]):
        raise ExplosionError(f"{n['left_rows']} rows would become {n['join_rows']}")
    return n["join_rows"]


def join_factors(root: DataFrame, steps: list[tuple[DataFrame, DataFrame, list[tuple[str, str]]]]) -> DataFrame:
    """(step, n): at step 0 the root's rows, then how often the most frequent key stands on each right side of the steps (left,
    right, keys). The product up to a step bounds its join from above; one job over the tables, not over their joins."""
    counts = [root.agg(F.count("*").alias("n"))] + [right.groupBy(*[r for _, r in keys]).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")) for _, right, keys in steps]
    return reduce(DataFrame.unionByName, [c.select(F.lit(i).alias("step"), "n") for i, c in enumerate(counts)])


def guard_joins(root: DataFrame, steps: list[tuple[DataFrame, DataFrame, list[tuple[str, str]]]], most_factor: float = MOST_FACTOR, most_rows: int = MOST_ROWS) -> None:
    """guard_join for each step (left, right, keys) of a plan, by the bounds of join_factors. A join whose keys are unique on its right
    side gives no more rows than its left side has; of the others only one that its bound doesn't clear is counted exactly."""
    first, *times = [r["n"] for r in sorted(join_factors(root, steps).collect(), key=lambda r: r["step"])]  # a row a table
    bound = first
    for (left, right, keys), n in zip(steps, times):
        if n <= 1:
            continue
        before, bound = bound, bound * n
        if bound > most_rows or bound > most_factor * max(1, before):
            bound = max(guard_join(left, right, keys, most_factor, most_rows), 1)


def rank_columns(plan: StarPlan, available: list[str]) -> list[tuple[str, bool]]:
    """The first present rank column and up to two present tie breakers (descending)."""
    first = next(((c, d) for c, d in plan.rank if c in available), None)
    return [first, *[(c, True) for c in plan.tie_breakers if c in available and c != first[0]][:2]] if first else []


def sort_column(key: SortKey) -> Column:
    if key.order:
        return F.asc(category_place(F.col(key.column).cast("string"), list(key.order)))
    if key.contains_first:
        return F.asc(any_of_first(F.col(key.column).cast("string"), list(key.contains_first)))
    return F.desc_nulls_last(key.column) if key.descending else F.asc_nulls_last(key.column)


def ordering(ranked: list[tuple[str, bool]], columns: list[str], sort: tuple[SortKey, ...] = ()) -> list[Column]:
    """Sort keys that are there, then ranks, then every output column, nulls last throughout: a total order."""
    named = [sort_column(k) for k in sort if k.column in columns] + [F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in ranked]
    return named + [F.asc_nulls_last(c) for c in columns if c not in {c for c, _ in ranked}]


def linked_to_all(df: DataFrame, field: str, values: list[str], keys: list[str]) -> DataFrame:
    """Rows whose keys are linked to every one of the values; nothing if they aren't all present."""
    wanted = sorted({v.lower() for v in values})
    hit = df.where(F.lower(F.col(field)).isin(wanted))
    full = hit.groupBy(*keys).agg(F.countDistinct(F.lower(F.col(field))).alias("__n")).where(F.col("__n") >= len(wanted)).select(*keys)
    return hit.join(full, keys, "left_semi")


def run(catalog: Catalog, plan: StarPlan, filters: Filters, *, kinds=None, any_of=(), operators=None, before: Callable | None = None, after: Callable | None = None, on_empty: Callable | None = None, guard: bool = True, most_rows: int = MOST_ROWS, observe: bool = False) -> QueryResult:
    """Hooks: before(filters) may change the filters, after(rows) the result; on_empty(filters) gives the filters
    of a second attempt if the first finds nothing (which then has to be run to be known). guard: an error before anything is
    joined if a join would give more than most_rows and more than its sides have together. observe: the joined rows are run at once and stored in the shared folder, and
    `joins` is what that run counted, at no further pass. A stage that is run again after an executor was lost may be counted twice in it;
    without observe, and where nothing is left, `joins` counts each join from the histograms of its keys, exactly."""
    filters = before(filters) if before else filters
    filters = {k: [plan.rewrites.get(k, {}).get(str(x).strip().lower(), x) for x in v] if isinstance(v, list) else v for k, v in filters.items()}
    how = {"kinds": kinds, "any_of": any_of, "operators": operators}
    guard_filters(filters, {c for t in plan.parents for c in catalog[t].columns})
    tables = {t: predicates.filter_table(catalog[t], filters, **how) for t in plan.parents}
    root = next(t for t, p in plan.parents.items() if p is None and t not in plan.decorations)
    done, rows, names, joins, guarded, marks = {root}, tables[root], [], [], [], []
    seen = counted(rows, marks) if observe else rows  # apart from rows, which the guard may run
    while len(done) < len(plan.parents):
        child = next((t for t, p in plan.parents.items() if t not in done and p in done), None)
        if child is None:
            raise MissingJoinError(f"{sorted(set(plan.parents) - done)} hang on no joined table")
        keys = join_keys(plan, plan.parents[child], child, set(rows.columns), tables[child])
        guarded.append((rows, tables[child], keys))
        how_joined = "left" if child in plan.decorations else "inner"
        joins.append(join_step(rows, tables[child], keys, how_joined).select(F.lit(len(joins) + 1).alias("step"), F.lit(child).alias("table"), "rows_before", "rows_after"))
        seen = counted(attach(seen, tables[child], keys, how_joined), marks) if observe else rows
        rows = attach(rows, tables[child], keys, how_joined)
        names.append(child)
        done.add(child)
    if guard and guarded:
        guard_joins(tables[root], guarded, most_rows=most_rows)
    joined = reduce(DataFrame.unionByName, joins) if joins else None
    if observe:
        needed = [*plan.outputs, *filters, *plan.require_all, *[c for c, _ in rank_columns(plan, rows.columns)], *[k.column for k in plan.sort]]
        needed = [c for c in dict.fromkeys(needed) if c in rows.columns]
        rows = stored(seen.select(*needed).distinct(), "joined")
        # Spark leaves steps out where it finds a side empty, and with them their counts; the result has no rows then.
        joined = observed_joins(rows.sparkSession, names, marks) if names and not rows.isEmpty() else joined
    for field, values in plan.require_all.items():
        entity = [c for c in plan.outputs if c in rows.columns and c != field]
        rows = linked_to_all(rows, field, values, entity)
    ranked = rank_columns(plan, rows.columns)
    wanted = [*plan.outputs, *[c for c in filters if values_of(filters, c)], *[c for c, _ in ranked[:1]]]
    columns = [c for c in dict.fromkeys(wanted) if c in rows.columns]
    if not columns:
        return QueryResult(rows.limit(0).select(*[F.lit(None).cast("string").alias(c) for c in plan.outputs]))
    rows = rows.select(*columns).distinct()
    rows = after(rows) if after else rows
    rows = rows.orderBy(*ordering([r for r in ranked if r[0] in rows.columns], rows.columns, plan.sort))
    if on_empty and rows.isEmpty():
        return run(catalog, plan, on_empty(filters), kinds=kinds, any_of=any_of, operators=operators, after=after, guard=guard, most_rows=most_rows, observe=observe)
    steps = [predicates.funnel(catalog[t], filters, **how).withColumn("table", F.lit(t)) for t in plan.parents if predicates.table_predicates(catalog[t], filters, **how)]
    return QueryResult(rows, reduce(DataFrame.unionByName, steps) if steps else None, joined)
