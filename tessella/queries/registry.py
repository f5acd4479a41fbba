"""The dictionary of queries, and views that several of them read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


#: Rows of lineitem for each task that counts pairs of parts.
TASK_ROWS = 500_000


class Tables:
    """The tables of a folder as attributes, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Derived views; their SQL stands in VIEWS.

    @property
    def links(self) -> DataFrame:
        """(part, supplier) pairs with their rows, flags and greatest price."""
        flags = F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|")
        return self.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), flags.alias("flags"), F.max("l_extendedprice").alias("price"))

    @property
    def pairs(self) -> DataFrame:
        """Parts ordered together, a < b, with the number of orders."""
        # Nearly every pair is new, so partial sums save nothing and take a task's memory: pairs go to as many tasks as rows need.
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.lineitem.count() // TASK_ROWS))
        o = self.lineitem.select("l_orderkey", "l_partkey").distinct()
        both = o.toDF("o", "a").join(o.toDF("o", "b"), "o").where("a < b").select("a", "b")
        return both.repartition(n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("score"))

    @property
    def hier(self) -> DataFrame:
        """region > nation > customer as (parent_id, parent_name, child_id, child_name)."""
        rn = self.region.join(self.nation, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("r"), "r_regionkey").alias("parent_id"), F.col("r_name").alias("parent_name"), F.concat(F.lit("n"), "n_nationkey").alias("child_id"), F.col("n_name").alias("child_name"))
        nc = self.nation.join(self.customer, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat(F.lit("n"), "n_nationkey"), F.col("n_name"), F.concat(F.lit("c"), "c_custkey"), F.col("c_name"))
        return rn.union(nc)

    @property
    def syn(self) -> DataFrame:
        """(id, synonym): swapped words, brand and name, upper case."""
        w = F.split("p_name", " ")
        forms = F.array(F.concat_ws(" ", F.element_at(w, 2), F.element_at(w, 1)), F.concat_ws(" ", "p_brand", "p_name"), F.upper("p_name"))
        return self.part.select(F.col("p_partkey").alias("id"), F.explode(forms).alias("synonym"))

    @property
    def nested(self) -> DataFrame:
        """One JSON text per order: parts with their suppliers and scores; every seventh order's list is empty."""
        # An order's rows meet once: both groupings go by what one shuffle by the order has dealt out.
        rows = self.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity").repartition("l_orderkey")
        item = rows.groupBy("l_orderkey", "l_partkey").agg(
            F.array_sort(F.collect_set(F.struct(F.col("l_suppkey").cast("string").alias("id"), F.col("l_returnflag").alias("status")))).alias("targets"),
            F.max("l_quantity").alias("score"),
        )
        item = item.select("l_orderkey", F.struct(F.col("l_partkey").alias("part"), "score", "targets").alias("item"))
        rows = item.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("item")).alias("items"))
        empty = F.when(F.col("l_orderkey") % 7 == 0, F.slice("items", 1, 0)).otherwise(F.col("items"))
        return rows.select("l_orderkey", F.to_json(F.struct(empty.alias("items"))).alias("doc"))


NESTED = "items array<struct<part:bigint,score:double,targets:array<struct<id:string,status:string>>>>"

VIEWS = {
    "links": "select l_partkey, l_suppkey, count(*) as n, array_to_string(list_sort(list(distinct l_returnflag)), '|') as flags, max(l_extendedprice) as price from lineitem group by all",
    "pairs": "select x.l_partkey as a, y.l_partkey as b, count(*) as score from (select distinct l_orderkey, l_partkey from lineitem) x join (select distinct l_orderkey, l_partkey from lineitem) y using (l_orderkey) where x.l_partkey < y.l_partkey group by all",
    "hier": "select 'r' || r_regionkey as parent_id, r_name as parent_name, 'n' || n_nationkey as child_id, n_name as child_name from region join nation on r_regionkey = n_regionkey union all select 'n' || n_nationkey, n_name, 'c' || c_custkey, c_name from nation join customer on n_nationkey = c_nationkey",
    "syn": "select p_partkey as id, unnest([split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1), p_brand || ' ' || p_name, upper(p_name)]) as synonym from part",
    # The items of the JSON texts, as rows.
    "items": "select l_orderkey, l_partkey as part, max(l_quantity) as score, list_sort(list(distinct {'id': l_suppkey::varchar, 'status': l_returnflag})) as targets from lineitem where l_orderkey % 7 <> 0 group by all",
}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a query; views names those that its SQL reads."""

    def keep(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ctes = [f"{v} as ({VIEWS[v]})" for v in views.split()]
            body = sql.strip()
            if ctes and body.lower().startswith("with recursive"):
                body = "with recursive " + ", ".join(ctes) + ", " + body[14:]
            elif ctes and body.lower().startswith("with"):
                body = "with " + ", ".join(ctes) + ", " + body[4:]
            elif ctes:
                body = "with " + ", ".join(ctes) + " " + body
            SQL[name] = body
        return f

    return keep
