"""Vector retrieval (group I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.operators import retrieval as V

from .registry import query

SIMS = "s as (select q.vec_id as qid, v.vec_id as id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score, q.label as ql, v.label as vl from embeddings q, embeddings v where q.vec_id % 20 = 0)"


#: Lists and probes of the index, whose recall tests/test_edges.py measures. The vectors of the test tables have no
#: clusters but near duplicates: for the nearest ten most lists must be probed, for near duplicates a tenth.
INDEX, GATE = {"lists": 16, "probes": 12}, {"lists": 32, "probes": 3}


def queries(t):
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), "label")


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def hits(t, k):
    return V.cosine_top_k(queries(t).drop("label"), vectors(t).drop("label"), k)


@query("cosine_topk", f"with {SIMS} select qid, id, score from (select *, row_number() over (partition by qid order by score desc, id) as rn from s) where rn <= 10")
def _(t):
    return hits(t, 10)


@query("cosine_topk_payload", f"with {SIMS} select qid, id, score from (select *, row_number() over (partition by qid order by score desc, id) as rn from s where ql = vl and score >= 0.1) where rn <= 10")
def _(t):
    return V.cosine_top_k(queries(t), vectors(t), 10, payload="label", least=0.1)


@query("max_merge", f"with {SIMS}, a as (select qid, id, score from (select *, row_number() over (partition by qid order by score desc, id) as rn from s) where rn <= 5), b as (select qid, id, score * 0.5 + 0.4 as score from (select *, row_number() over (partition by qid order by score desc, id) as rn from s) where rn <= 8) select qid, id, max(score) as score from (select * from a union all select * from b) group by all")
def _(t):
    return V.merged(hits(t, 5), hits(t, 8).withColumn("score", F.col("score") * 0.5 + 0.4))


@query("share_cut", f"with {SIMS}, h as (select qid, id, score from (select *, row_number() over (partition by qid order by score desc, id) as rn from s) where rn <= 20), l as (select qid, min(score) as low from (select *, row_number() over (partition by qid order by score desc, id) as rn from h) where rn <= 4 group by 1) select h.* from h join l using (qid) where score >= low")
def _(t):
    return V.share_cut(hits(t, 20))


def knee_sql(fallback: str) -> str:
    """The difference curve and its peaks by windows; a peak's segment reaches to the next peak."""
    return f"""with {SIMS}, h as (select qid, id, score from (select *, row_number() over (partition by qid order by score desc, id) as rn from s) where rn <= 40),
    r as (select *, row_number() over (partition by qid order by score desc, id) - 1 as i, count(*) over (partition by qid) as n, max(score) over (partition by qid) as hi, min(score) over (partition by qid) as lo from h),
    d as (select *, case when n >= 3 and hi > lo then 1 - (score - lo) / (hi - lo) - i / (n - 1) end as d from r),
    p as (select *, coalesce(d >= lag(d) over (partition by qid order by i) and d > lead(d) over (partition by qid order by i), false) as peak from d),
    g as (select *, sum(peak::int) over (partition by qid order by i) as seg from p),
    k as (select qid, min(top) as knee from (select qid, seg, min(i) filter (where peak) as top, min(d) filter (where not peak) < min(d) filter (where peak) - 0.5 / (max(n) - 1) as falls from g where seg > 0 group by all) where falls group by qid),
    l as (select r.qid, coalesce(min(score) filter (where i = knee), {fallback}) as low from r left join k using (qid) group by r.qid)
    select h.* from h join l using (qid) where score >= low"""


@query("knee", knee_sql("min(score)"))
def _(t):
    return V.knee_cut(hits(t, 40))


@query("knee_median", knee_sql("median(score)"))
def _(t):
    return V.knee_cut(hits(t, 40), fallback="median")


@query(
    "blend",
    """with x as (select vec_id as id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings),
    n as (select a.vec_id as root, b.vec_id as node from embeddings a join embeddings b on abs(a.vec_id - b.vec_id) = 1),
    m as (select root as id, i, avg(x) as m from n join x on x.id = n.node group by all),
    b as (select x.id, x.i, 0.9 * x + 0.1 * m as b from x join m using (id, i)),
    l as (select id, sqrt(sum(b * b)) as len from b group by 1)
    select id, i, round(b / len, 5) as x from b join l using (id)""",
)
def _(t):
    ids = t.embeddings.select(F.col("vec_id").alias("a"))
    e = ids.select("a", (F.col("a") + 1).alias("b"), F.lit("0").alias("kind")).join(ids.toDF("b"), "b", "left_semi")
    near = G.neighbours(e, ids.toDF("root"), 1)
    out = V.blend(vectors(t).drop("label"), near)
    return out.select("id", F.posexplode("v").alias("i", "x")).select("id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 5).alias("x"))


@query("relevance", "select vec_id, label, round(embedding[1]::double / sqrt(list_inner_product(embedding::double[], embedding::double[])), 4) as relevance_score from embeddings")
def _(t):
    return V.relevance(t.embeddings, "embedding", [1.0] + [0.0] * 63).drop("embedding")


@query(
    "pinned",
    f"with {SIMS}, h as (select qid, id, score from (select *, row_number() over (partition by qid order by score desc, id) as rn from s) where rn <= 20) select qid, id, p as pinned, score from (select h.*, label = 0 as p, row_number() over (partition by qid order by (label = 0) desc, score desc, 't' || (id % 7), id) as rn from h join embeddings on id = vec_id) where p or rn <= 5",
)
def _(t):
    bank = t.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("t"), F.col("vec_id") % 7).alias("text"), (F.col("label") == 0).alias("pinned"))
    return V.pinned_first(hits(t, 20), bank, 5)


@query("hit_tables", f"with {SIMS}, h as (select qid, id from (select *, row_number() over (partition by qid order by score desc, id) as rn from s) where rn <= 3), n as (select qid, id from h union select qid, id + 1 from h union select qid, id - 1 from h) select distinct qid, label as tab from n join embeddings on id = vec_id")
def _(t):
    edges = t.embeddings.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return V.tables_of(hits(t, 3), edges, t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("tab")))


@query(
    "bank_replace",
    "select 'd' || (p_size % 5) as db, p_type as stage, p_name as question, sha256('d' || (p_size % 5) || chr(31) || p_type || chr(31) || p_name) as id, 'old' as src from (select distinct p_size % 5 as p_size, p_type, p_name from part where not (p_size % 5 = 1 and p_type = 'SMALL')) union all select 'd1', 'SMALL', p_name, sha256('d1' || chr(31) || 'SMALL' || chr(31) || p_name), 'new' from (select distinct p_name from part)",
)
def _(t):
    rows = lambda df, src: df.select("db", "stage", "question", V.content_id("db", "stage", "question").alias("id"), F.lit(src).alias("src")).distinct()
    old = t.part.select(F.concat(F.lit("d"), F.col("p_size") % 5).alias("db"), F.col("p_type").alias("stage"), F.col("p_name").alias("question"))
    new = t.part.select(F.lit("d1").alias("db"), F.lit("SMALL").alias("stage"), F.col("p_name").alias("question"))
    return V.replace_slices(rows(old, "old"), rows(new, "new"))


@query("near_dup_gate", f"with {SIMS} select qid, max(score) < 0.92 as fresh from s where qid <> id group by 1")
def _(t):
    top = hits(t, 2).where("qid <> id").groupBy("qid").agg(F.max("score").alias("score"))
    return top.select("qid", (F.col("score") < 0.92).alias("fresh"))


@query("near_dup_gate_index")
def _(t):
    return V.near_duplicate_gate(queries(t).drop("label"), vectors(t).drop("label"), **GATE)


@query("approx_topk")
def _(t):
    return V.approximate_top_k(queries(t).drop("label"), vectors(t).drop("label"), 10, **INDEX)
