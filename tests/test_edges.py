"""Small tables for what the given data don't hold: nulls, blanks, ties, empty sides, repeats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import predicates as P
from tessella.functions import text as X
from tessella.operators import graph as G
from tessella.operators import inject as J
from tessella.operators import keyed as K
from tessella.operators import ordering as O
from tessella.operators import resolve as R
from tessella.operators import retrieval as V
from tessella.operators import summary as S
from tessella.plans import spec, star
from tessella.sources import curate as C
from tessella.streaming import bank as B
from tessella.streaming import feedback as L


def column(df, name=None):
    return [r[0] for r in df.select(name or df.columns[0]).collect()]


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def kept(spark, values, p):
    return column(spark.createDataFrame([(v,) for v in values], "v string").where(p))


def test_whole_word(spark):
    assert kept(spark, ["glioma", "gliomas", "paraglioma", None], P.whole_word("v", ["gliomas"])) == ["glioma", "gliomas"]
    assert P.variants("sepsis") == ["sepsis"]
    assert kept(spark, ["c.5266dup", "é5266"], P.whole_word("v", ["c.5266dupc"])) == ["c.5266dup"]
    assert kept(spark, ["über", "ber", "x ber."], P.whole_word("v", ["ber"])) == ["ber", "x ber."]


def test_component(spark):
    rows = ["benign", "likely benign", "pathogenic/likely pathogenic; risk factor", None]
    assert kept(spark, rows, P.component("v", ["Benign"])) == rows[:1]
    assert kept(spark, rows, P.component("v", ["pathogenic"])) == rows[2:3]


def test_notation(spark):
    rows = ["x (p.Val600Glu)", "x (p.val600lys)", "p.Val600GlufsTer12", "rs123 x", "rs1234", "BRAF V600E", "xval600glu"]
    assert kept(spark, rows, P.notation("v", ["v600e"])) == [rows[0], rows[5]]
    assert kept(spark, rows, P.notation("v", ["p. V600"])) == rows[:2]
    assert kept(spark, rows, P.notation("v", ["rs123", "V600E"])) == [rows[0], rows[3], rows[5]]
    assert P.protein_pattern("rs123") is None and P.protein_pattern("R213*") == r"\barg213ter\b" and P.protein_pattern("p.J5K") is None


def test_filters_that_depend(spark):
    names = spark.createDataFrame([("glioma",)] + [("syndrome x",)] * 30 + [("other",)] * 69, "n string")
    assert [tuple(r) for r in P.relaxed("Pediatric glioma", names, "n").collect()] == [("glioma", 1)]
    assert P.relaxed("odd syndrome", names, "n").count() == 0 and P.relaxed("", names, "n").count() == 0
    raw = spark.createDataFrame([("SO:1|missense_variant,SO:2|stop_lost",), (None,), ("SO:1|missense_variant, ",)], "c string")
    vocab = P.vocabulary(raw, "c")
    assert sorted(column(vocab)) == ["missense variant", "stop lost"]
    assert column(P.in_vocabulary(vocab, ["Missense variants"])) == ["missense variant"] and P.in_vocabulary(vocab, []).count() == 0
    base = {"gene": ["A"]}
    assert P.injected(base, "evidence", "marker", entities=("gene",), tables={"t"}, table="t") == {"gene": ["A"], "evidence": ["marker"]}
    for filters, tables, value in ((base | {"evidence": ["x"]}, {"t"}, "marker"), ({"gene": "requested"}, {"t"}, "marker"), (base, {"u"}, "marker"), (base, {"t"}, None)):
        assert P.injected(filters, "evidence", value, entities=("gene",), tables=tables, table="t") == filters
    assert P.prefix_in("the KEGG and reactome sets", [("reactome", "R_"), ("kegg", "K_")]) == "R_" and P.prefix_in("keggs", [("kegg", "K_")]) is None
    assert P.pruned(names, {"n": "drug", "absent": "gene"}, {"gene"}).columns == []


def test_buckets(spark):
    rows = [(1, {"SM": {"Approved": True, "Lead": False}, "AB": {"High": True}}), (2, {"SM": {"Lead": None}}), (3, None), (4, {"AB": None})]
    df = spark.createDataFrame(rows, "id int, m map<string,map<string,boolean>>")
    got = lambda **how: {r.id: r.buckets for r in P.with_buckets(df, "m", **how).collect()}
    assert got() == {1: "AB:High; SM:Approved"} and got(modality="sm") == {1: "SM:Approved"} and got(any_of=["high"]) == {1: "AB:High"}
    assert set(got(negated=True)) == {2, 3, 4} and set(got(negated=True, any_of=["lead"])) == {1, 2, 3, 4}


def test_ends_named(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("a", "a", 4)], "x string, y string, n int")
    named = lambda *k: spark.createDataFrame([(v,) for v in k], "key string")
    assert sorted(r.n for r in P.between(edges, "x", "y", named("a", "b")).collect()) == [1, 4]
    assert sorted(r.n for r in P.between(edges, "x", "y", named("a"), known=1).collect()) == [1, 3, 4]


def test_threshold(spark):
    df = spark.createDataFrame([(5.0,), (10.0,), (11.0,), (None,)], "v double")
    assert column(df.where(P.threshold("v", ["x", 10]))) == [5.0, 10.0]
    assert column(df.where(P.threshold("v", [10], "gt"))) == [11.0]
    assert P.threshold("v", ["x"]) is None


def test_null_tolerant_and_keep_if_any(spark):
    assert kept(spark, ["a", None, "", "b"], P.null_tolerant("v", ["A"])) == ["a", None, ""]
    df = spark.createDataFrame([(600,), (650,), (None,)], "v int")
    assert df.transform(lambda d: P.keep_if_any(d, F.col("v") >= 700)).count() == 3
    assert column(P.keep_if_any(df, F.col("v") >= 650)) == [650]
    assert P.keep_if_any(df.limit(0), F.col("v") > 0).count() == 0


def test_long_list_becomes_a_join(spark):
    df = spark.createDataFrame([("a",), ("B",), (None,)], "v string")
    assert column(P.filter_table(df, {"v": [f"x{i}" for i in range(1200)] + ["b"]})) == ["B"]


def test_filters():
    assert spec.normalise_filters({"a": "x", "b": ["", None], "c": "requested", "d": [" "]}) == {"a": ["x"], "c": "requested"}
    with pytest.raises(spec.NoFilterError):
        spec.guard_filters({"a": "requested"}, {"a"})
    with pytest.raises(spec.NoFilterError):
        spec.guard_filters({"a": ["x"]}, {"b"})


def test_missing_join(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, n string"), spark.createDataFrame([(1,)], "j int")
    with pytest.raises(spec.MissingJoinError):
        star.run({"a": a, "b": b}, spec.StarPlan({"a": None, "b": "a"}, outputs=("n",)), {"n": ["x"]})


def test_explosion(spark):
    a = spark.range(200).select(F.lit(1).alias("k"))
    with pytest.raises(spec.ExplosionError):
        star.guard_join(a, a, [("k", "k")], most_factor=100)


def test_guard_is_on(spark):
    """The bound clears what is small; beyond it a join is counted, and only then refused."""
    a = spark.createDataFrame([(i, i % 2) for i in range(40)], "id int, k int")
    b = spark.createDataFrame([(i % 2, i) for i in range(40)] + [(None, 1)], "k2 int, v int")
    c = spark.createDataFrame([(1, "x")] * 30 + [(2, "y")], "v3 int, name string")
    joins = (spec.JoinEdge("a", "b", ("k",), ("k2",)), spec.JoinEdge("b", "c", ("v",), ("v3",)))
    plan = spec.StarPlan(parents={"a": None, "b": "a", "c": "b"}, joins=joins, outputs=("id", "name"))
    catalog = {"a": a, "b": b, "c": c}
    # a and b give 800 rows, with c 20 * 30 + 20; the bound of the second is 24,000.
    assert star.run(catalog, plan, {"name": ["x", "y"]}, most_rows=800).rows.count() == 40
    with pytest.raises(spec.ExplosionError):
        star.run(catalog, plan, {"name": ["x", "y"]}, most_rows=799)
    with pytest.raises(spec.ExplosionError):
        star.guard_joins(a, [(a, b.where("k2 = 0"), [("k", "k2")])], most_factor=9)
    assert star.run(catalog, plan, {"name": ["x", "y"]}, guard=False, most_rows=1).rows.count() == 40
    assert star.run({**catalog, "b": b.limit(0)}, plan, {"name": ["x"]}).rows.count() == 0


def test_guard_lets_large_tables_join(spark):
    """Joins that give no more rows than they read pass at any size; one that multiplies them is still refused."""
    fact = spark.range(60).select("id", (F.col("id") % 7).cast("int").alias("k"))
    one, two = spark.range(7).select(F.col("id").cast("int").alias("k2"), F.lit("x").alias("name")), spark.range(60).select((F.col("id") % 50 + 30).alias("f"), F.lit(1).alias("v"))
    joins = (spec.JoinEdge("fact", "one", ("k",), ("k2",)), spec.JoinEdge("fact", "two", ("id",), ("f",)))
    plan = spec.StarPlan(parents={"fact": None, "one": "fact", "two": "fact"}, joins=joins, outputs=("id", "v"))
    catalog = {"fact": fact, "one": one, "two": two}
    got = star.run(catalog, plan, {"name": ["x"]}, most_rows=5)
    assert got.rows.count() == 30 and [r.rows_after for r in got.joins.orderBy("step").collect()] == [60, 40]
    with pytest.raises(spec.ExplosionError):  # 60 rows at 4 for each key, with 120 read
        star.run({**catalog, "one": one.union(one).union(one).union(one)}, plan, {"name": ["x"]}, most_rows=5)


def test_packed_and_keys(spark):
    assert one(spark, ["1|2|3", "", None], X.packed_length) == [3, 0, 0]
    df = spark.createDataFrame([("TP53", None), ("A", "b")], "x string, y string")
    assert column(df.select(C.composite_key("x", "y"))) == [None, "A|b"]


def test_linked_to_all(spark):
    df = spark.createDataFrame([("x", "A"), ("x", "B"), ("y", "A"), (None, "A"), (None, "B")], "e string, f string")
    assert sorted(map(tuple, star.linked_to_all(df, "f", ["a", "B"], ["e"]).collect())) == [("x", "A"), ("x", "B")]
    assert star.linked_to_all(df, "f", ["a", "C"], ["e"]).count() == 0


def test_category_order(spark):
    df = spark.createDataFrame([("odd",), ("Approved",), ("Phase 2",)], "v string")
    assert column(df.orderBy(O.category_place(F.col("v"), ["Phase 2", "Approved"]))) == ["Phase 2", "Approved", "odd"]


def test_text(spark):
    assert one(spark, ["APPROVAL", "PHASE_2_3", "PRECLINICAL", None, " "], X.phase_ordinal) == [5, 3, 0, -1, -1]
    assert len(set(one(spark, ["tuberculosis, pulmonary", "Pulmonary tuberculosis"], X.match_key))) == 1
    assert one(spark, ["--", "", None], X.match_key) == [None] * 3
    assert one(spark, ["type IV", "Type vi b", "type X"], X.roman_types) == ["type 4", "Type 6 b", "type X"]
    assert one(spark, ["imatinib mesylate", "imatinib", "HCl"], X.without_salt) == ["imatinib", None, None]
    assert one(spark, ["gliomas", "glioma", "sepsis", "x1", None], X.plural_variant) == ["glioma", "gliomas", None, None, None]
    assert one(spark, ["Wilson’s x", "a–b"], X.safe_normalise) == ["wilson x", "a-b"]


def scored(spark, rows):
    return spark.createDataFrame(rows, "drug_name string, association_score string")


def test_set_operations(spark):
    a, b = scored(spark, [("X", "0.9"), ("y", "0.1"), ("", "1"), (None, "1")]), scored(spark, [(" x ", None), ("Y", "0.9")])
    got = {r["drug_name"]: r["association_score"] for r in K.intersect(a, b, "drug_name").collect()}
    assert got == {"X": None, "y": 0.1}
    assert {r["drug_name"].strip().lower(): r["association_score"] for r in K.union(a, b, "drug_name").collect()} == {"x": "0.9", "y": "0.1"}
    assert {r["drug_name"].strip().lower(): r["association_score"] for r in K.union(a, b, "drug_name", best=True).collect()} == {"x": "0.9", "y": "0.9"}
    assert K.difference(a, b, "drug_name").count() == 0
    assert K.difference(a, b.limit(0), "drug_name").count() == 4
    assert K.intersect(a, b.limit(0), "drug_name").count() == 0


def test_many_to_one(spark):
    a = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        K.many_to_one(a, a.union(a), ["k"])


def test_detect_key(spark):
    a, b = spark.createDataFrame([("", "1")], "gene_id string, z string"), spark.createDataFrame([("1", "1")], "gene_id string, z string")
    assert K.detect_key(a, b) == ("z", "shared") and K.detect_key(a, b.select(F.col("z").alias("q"))) is None


def test_curation(spark):
    edges = spark.createDataFrame([(1, 2, "e"), (2, 3, "f")], "a int, b int, n string")
    both = C.both_directions(edges, "a", "b")
    assert {(r.a, r.b) for r in both.collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}
    master = spark.createDataFrame([(2, "x"), (2, "x"), (9, "y")], "id int, name string")
    assert C.partner_attributes(edges, master, partner_fk="b", master_key="id", attrs=["name"]).count() == 2
    assert C.extend_dimension(master, edges, "id", "b").count() == 4
    assert one(spark, ["MESH:KEGG:1", "x", None], C.strip_prefixes) == ["1", "x", None]
    assert one(spark, ["ENSG00000000001.2", "x"], lambda c: C.extract(c, r"(ENSG\d{11})")) == ["ENSG00000000001", None]


def test_summaries(spark):
    df = spark.createDataFrame([(None, "a"), (1, None)], "x int, y string")
    assert S.drop_null_rows(df).count() == 2 and S.drop_null_rows(df.union(spark.createDataFrame([(2, "b")], "x int, y string"))).count() == 1
    assert S.drop_empty(spark.createDataFrame([("", "a"), (" ", "")], "x string, y string")).columns == ["y"]


def test_top_ids(spark):
    df = spark.createDataFrame([("A", "1"), ("a ", "3"), ("b", "x"), ("", "9"), (None, "9")], "k string, s string")
    assert [r.k.strip().lower() for r in O.top_ids(df, "k", "s", 0).collect()] == ["a"]
    assert O.row_limit("top 9999") == 200 and O.row_limit("all") == 25


def test_budget_keeps_one_row(spark):
    df = spark.createDataFrame([(i, "x" * 50) for i in range(8)], "i int, t string")
    assert O.within_budget(df, [F.asc("i")], 8, 10).count() == 1
    assert O.within_budget(df, [F.asc("i")], 8, 100_000).count() == 8


def test_exact_medians(spark):
    """Against Spark's own, with ties, one hot group of distinct values, groups of one and two, texts and nulls; none has all of a group."""
    rng = np.random.default_rng(6)
    rows = [("hot", str(x)) for x in rng.permutation(60_000) / 7] + [("ties", str(int(x))) for x in rng.integers(0, 3, 5000)]
    rows += [("one", "4"), ("two", "1"), ("two", "2"), ("none", None), ("none", "n/a"), (None, "3"), (None, "5"), (None, "100"), ("inf", "Infinity"), ("inf", "1")]
    df = spark.createDataFrame(rows, "g string, v string")
    got = {r["g"]: r.median for r in S.statistics(df, "v", ["g"], in_task=100).collect()}
    want = {r["g"]: r.median for r in df.groupBy("g").agg(F.median(F.col("v").try_cast("double")).alias("median")).collect()}
    assert got == want
    whole = S.statistics(df, "v", in_task=100).collect()
    assert [r.median for r in whole] == [df.agg(F.median(F.col("v").try_cast("double"))).first()[0]]
    assert [tuple(r) for r in S.statistics(df.limit(0), "v", in_task=-1).collect()] == [(None,) * 5] and S.statistics(df.limit(0), "v", ["g"], in_task=-1).count() == 0
    hot = df.where("g = 'hot'").select("g", F.col("v").cast("double").alias("x"))
    lo, hi = hot.agg(*S.bracket("x", 2 / S.ACCURACY)).select("lo", "hi").first()
    assert 0 < hot.where(F.col("x").between(lo, hi)).count() < 0.002 * 60_000


def test_medians_with_brackets_that_miss(spark):
    rows = spark.createDataFrame([(g, float(x)) for g in "ab" for x in range(101)], "g string, x double")
    off = spark.createDataFrame([("a", 101, 80.0, 90.0), ("b", 101, 0.0, 10.0)], "g string, n long, lo double, hi double")
    assert dict(S.medians(rows, off).collect()) == {"a": 50.0, "b": 50.0}


def test_hubs_walk_as_edges_do(spark):
    import random

    rng = random.Random(9)
    rows = [(rng.choice("abcdefgh") if i % 3 else "hot", f"t{i % 4}", f"n{i % 90}") for i in range(200)] + [(None, "t1", "n1"), ("a", None, "n2"), ("a", "t1", None)]
    records = spark.createDataFrame(rows, "k string, tab string, node string")
    hubs = G.typed_hubs(records, "k", "tab", "node")
    start = spark.createDataFrame([("n1",), ("n7",), ("n89",), ("gone",)], "root string")
    for depth in (1, 2, 3):
        over_pairs = G.neighbours(G.typed_edges(records, "k", "tab", "node"), start, depth).collect()
        assert sorted(map(tuple, G.hub_neighbours(hubs, start, depth).collect())) == sorted(map(tuple, over_pairs))
    assert hubs.count() <= len(rows)  # linear, however hot a key


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "parent string, child string")
    got = {(r.node, r.depth) for r in G.descendants(edges, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_closure_of_a_long_chain(spark):
    edges = spark.range(60).selectExpr("id as parent", "id + 1 as child")
    got = {r.node: r.depth for r in G.descendants(edges, spark.createDataFrame([(0,)], "root long")).collect()}
    assert got == {i: i for i in range(61)}


def test_typed_paths(spark):
    e = spark.createDataFrame([("g1", "d1", "Drug", 0.5), ("g1", None, "Other", 0.9), ("g1", None, " other ", 0.4), ("g1", None, None, 0.3)], "gene string, drug string, name string, s double")
    registry = G.Edges({("gene", "drug"): (e, "gene", "drug")})
    assert registry.of("drug", "gene")[1:] == ("drug", "gene")
    with pytest.raises(KeyError):
        registry.of("gene", "disease")
    start = spark.createDataFrame([("g1", 1.0)], "gene string, s double")
    assert sorted((r.drug or "", r.name) for r in G.traverse(start, registry.path("gene", "drug"), score="s", name="name").collect()) == [("", "Other"), ("d1", "Drug")]
    assert [r.drug for r in G.traverse(start, registry.path("gene", "drug"), score="s").collect()] == ["d1"]


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k")
    got = {r.k: (r.n, r.s) for r in O.running(df, [F.asc("k")], {"n": F.lit(1), "s": F.col("k")}, 64).collect()}
    assert got == {k: (k, k * (k - 1) // 2) for k in range(1000)}


def test_fuzzy():
    assert R.lcs("kitten", "sitting") == 4 and round(R.ratio("kitten", "sitting"), 2) == 61.54
    assert R.token_sort_ratio("b a", "a b") == 100.0 and R.token_set_ratio("a b", "a b c") == 100.0
    assert R.partial_ratio("widget", "red widget") == 100.0


def test_fuzzy_misses_nothing(spark, sf_dir):
    """Names with edits, and short and repetitive texts, against all pairs."""
    import random

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pool = part.select(F.concat_ws(" ", "p_brand", "p_name").alias("value")).distinct()
    terms = part.select(F.col("p_partkey").alias("query"), F.concat(F.substring("p_name", 2, 30), F.lit("s")).alias("term"))
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("aab") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 4)))
    odd = [text() for _ in range(150)] + ["ab foo", "x", "", "aaaaaaa", "b b b"]
    values = spark.createDataFrame([(v,) for v in odd], "value string")
    asked = spark.createDataFrame(list(enumerate([text() for _ in range(100)] + ["ab", "a", "bbbbbbb", "foo ab x"])), "query long, term string")
    for t, p in ((terms, pool), (asked, values)):
        want = {(r["query"], r["value"]) for r in R.exhaustive(t, p).collect()}
        for hot in (R.HOT, 5):
            assert {(r["query"], r["value"]) for r in R.fuzzy(t, p, hot=hot).collect()} == want and want


def test_fuzzy_with_a_word_in_every_value(spark):
    """All pairs that score, and no key of words that more than a fifth of the texts have on both sides."""
    import random

    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 9)))
    values = [f"widget {name()}" for _ in range(400)] + [f"{name()} widget {name()}" for _ in range(100)]
    edited = [v.replace(v[8], "", 1) for v in values[::10]] + [" ".join(v.split()[::-1]) for v in values[::25]] + [f"widget {name()}" for _ in range(40)] + ["gidget abcdef"]
    t = spark.createDataFrame(list(enumerate(edited)), "query long, term string")
    p = spark.createDataFrame([(v,) for v in values], "value string")
    want = {(r["query"], r["value"], r.score) for r in R.exhaustive(t, p).collect()}
    assert {(r["query"], r["value"], r.score) for r in R.fuzzy(t, p, hot=50).collect()} == want and len(want) > 40
    keys = R.fuzzy_keys(p, "value", {}, {"widget"}, 82.0)
    met = keys.where("kind not in ('any', 'gram')").groupBy("kind", "key").count().agg(F.max("count")).first()[0]
    assert met <= 100


def rewritten(text, table, longest=5):
    """Word by word: the longest phrase that begins here, else the word."""
    words, out, i = text.split(), [], 0
    while i < len(words):
        for n in range(min(longest, len(words) - i), 0, -1):
            phrase = " ".join(words[i : i + n])
            head, tail = len(words[i]) - len(words[i].lstrip("([{\"'")), len(words[i + n - 1]) - len(words[i + n - 1].rstrip(".,;:!?)]}\"'"))
            core = phrase[head : len(phrase) - tail].lower()
            if core in table:
                out.append(phrase[:head] + table[core] + phrase[len(phrase) - tail :])
                i += n
                break
        else:
            out.append(words[i])
            i += 1
    return " ".join(out)


def test_ngram_rewrite(spark):
    import random

    table = {"a b": "X", "a": "Y", "b c d": "Long One", "c": "zed", "d e f g h": "five", "same": "Same", "h i j k l m": "six"}
    dictionary = spark.createDataFrame([*table.items(), ("A B", "Z"), (None, "x"), ("q", None)], "phrase string, target string")
    rng = random.Random(4)
    texts = ["(a b)? A, b", None, "", "  ", "\"a\" ('b c d'), same SAME. d e f g h", "?! ( a", "h i j k l m"]
    texts += [" ".join(rng.choice(["", "(", '"']) + rng.choice("abcdefgh") + rng.choice(["", ",", ")."]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += [" ".join("abc"[i % 3] for i in range(20_000)), texts[0]]
    got = sorted((r.id, r.rewritten) for r in R.rewrite_ngrams(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), dictionary).collect())
    known = {k: v for k, v in table.items() if k != v.lower()}
    assert got == [(i, None if t is None else rewritten(t, known)) for i, t in enumerate(texts)]


def test_ngram_rewrite_of_one_file_is_shared_by_tasks(spark):
    """Texts of one partition are dealt to several tasks, and runs are no longer than the dictionary's phrases."""
    texts = spark.range(400).select("id", F.concat(F.lit("(a  b) c, a x"), "id").alias("text")).coalesce(1)
    out = R.rewrite_ngrams(texts, spark.createDataFrame([("a b", "X"), ("c", "C c")], "phrase string, target string"))
    assert len([f for f in out.inputFiles() if "/texts-" in f]) > 1
    assert sorted(out.collect()) == sorted((i, f"(a  b) c, a x{i}", f"(X) C c, a x{i}") for i in range(400))
    assert R.rewrite_ngrams(texts.limit(1), spark.createDataFrame([], "phrase string, target string")).first()["rewritten"] == "(a b) c, a x0"


def test_tokens_where_no_filter_is_set(spark):
    rows = [(1, "Is XBP1 (not xbp1s!) in SLE or sle?", {}), (2, "xbp1", {"brand": ["B"]}), (3, None, None), (4, "", {"name": [None, " "]}), (5, "notch of gobp, notch", None), (6, "α1 ab", {}), (5, "notch of gobp, notch", None)]
    q = spark.createDataFrame(rows, "id int, text string, filters map<string, array<string>>")
    aliases = spark.createDataFrame([("sle", "LUPUS"), ("xbp1s", "XBP1"), ("ab", "TWO")], "word string, token string")
    tokens = S.token_frequency(spark.createDataFrame([("A_XBP1_NOTCH",), ("B_NOTCH_XBP1_ab_12",), (None,), ("XBP1",)], "n string"), "n", band=(2, 9), form="^[A-Z0-9]*[A-Z][A-Z0-9]*$")
    assert {r.token for r in tokens.collect()} == {"XBP1", "NOTCH"}
    got = sorted((r.id, r.filters) for r in J.with_tokens(q, "name", aliases, tokens).collect())
    assert got[0] == (1, {"name": ["XBP1", "LUPUS"]}) and got[1] == (2, {"brand": ["B"]}) and got[2] == (3, None) and got[3] == (4, {"name": [None, " "]})
    assert got[4] == got[5] == (5, {"name": ["NOTCH"]}) and got[6] == (6, {"name": ["TWO"]})
    prefixed = {r.id: r.filters for r in J.with_prefix(q, "name", [("gobp", "GOBP_"), ("go", "GO_")]).collect()}
    assert prefixed[5] == {"name": ["GOBP_"]} and prefixed[2] == {"brand": ["B"]} and prefixed[3] == {}
    shared = J.with_organism(q, ["o", "brand"], "(?i)in|of", [("SLE", "h"), ("notch", "m")])
    assert {r.id: r.filters for r in shared.collect()}[1] == {"o": ["h"], "brand": ["h"]}


def test_acronyms(spark):
    rows = [(1, "t2dm", "type 2 diabetes mellitus"), (1, "t2dm", "type 1 diabetes"), (2, "ra", "rheumatoid arthritis"), (3, "hcc", "hcc"), (3, "hcc", "liver thing"), (4, "x", None)]
    got = {(r["query"], r["term"]) for r in R.acronym_filter(spark.createDataFrame(rows, "query int, name string, term string")).collect()}
    assert got == {(1, "type 2 diabetes mellitus"), (2, "rheumatoid arthritis"), (3, "hcc"), (3, "liver thing")}


def test_alias_map(spark):
    aliases = spark.createDataFrame([(1, "z"), (2, "z"), (1, "zed"), (1, "Beta"), (3, "idle"), (1, "ALPHA")], "id int, alias string")
    names = spark.createDataFrame([(1, "Alpha"), (2, "beta"), (3, "gamma")], "id int, canonical string")
    active = spark.createDataFrame([(1,), (2,)], "id int")
    assert [tuple(r) for r in R.alias_map(aliases, names, active).collect()] == [("zed", "Alpha")]


def test_knee(spark):
    scores = [1.0, 0.9, 0.85, 0.2, 0.19, 0.18, 0.17]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)] + [(2, 0, 0.5)], "qid int, id int, score double")
    got = V.knee_cut(df).groupBy("qid").count().collect()
    assert {r["qid"]: r["count"] for r in got} == {1: 4, 2: 1}


def kneedle(scores, sensitivity):
    """The index of the knee, by the definition, or None."""
    n = len(scores)
    if n < 3 or scores[0] == scores[-1]:
        return None
    d = [1 - (x - scores[-1]) / (scores[0] - scores[-1]) - i / (n - 1) for i, x in enumerate(scores)]
    peaks = [i for i in range(1, n - 1) if d[i] >= d[i - 1] and d[i] > d[i + 1]]
    for i, after in zip(peaks, [*peaks[1:], n]):
        if any(x < d[i] - sensitivity / (n - 1) for x in d[i + 1 : after]):
            return i
    return None


@pytest.mark.parametrize("sensitivity", [0.5, 2.0])
def test_knee_by_definition(spark, sensitivity):
    rng = np.random.default_rng(11)
    curves = {q: np.sort(rng.random(rng.integers(1, 60)) ** rng.integers(1, 6))[::-1].round(int(rng.integers(1, 5))).tolist() for q in range(300)}
    df = spark.createDataFrame([(q, i, x) for q, c in curves.items() for i, x in enumerate(c)], "qid int, id int, score double")
    for fallback in ("all", "median"):
        got = {r["qid"]: r["count"] for r in V.knee_cut(df, sensitivity, fallback).groupBy("qid").count().collect()}
        for q, c in curves.items():
            k = kneedle(c, sensitivity)
            low = c[k] if k is not None else float(np.median(c)) if fallback == "median" else c[-1]
            assert got[q] == sum(x >= low for x in c)
    assert {kneedle(c, sensitivity) is None for c in curves.values()} == {True, False}


def test_approximate_query_recall(spark, sf_dir):
    """The registered query as it is: against the exact one, and its exact pairs against all."""
    from __spark_entry__ import QUERIES

    exact, found = ({(r.qid, r.id) for r in QUERIES[n](spark, "/root/testdata/sf0.01").collect()} for n in ("cosine_topk", "approx_topk"))
    assert len(exact & found) >= 0.9 * len(exact)
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q, v = e.where("vec_id % 20 = 0").selectExpr("vec_id as qid", "embedding as q"), e.selectExpr("vec_id as id", "embedding as v")
    assert V.candidates(q, v, 50, lists=16, probes=12).count() <= 0.1 * q.count() * v.count()


def test_gate_by_index(spark):
    """Near duplicates at the gate's distance, in a bank with a hot cluster: found in a tenth of the lists."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 32))
    base = base / np.linalg.norm(base, axis=1, keepdims=True)
    hot = base[0] + rng.normal(size=(300, 32)) * 0.02
    side = rng.normal(size=(400, 32))
    side -= (side * base).sum(1, keepdims=True) * base
    near = 0.93 * base + (1 - 0.93**2) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, hot]))] + [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32)]
    asked = [(10_000 + i, [float(x) for x in v]) for i, v in enumerate(near)] + [(20_000, None), (20_001, [0.0] * 32)]
    bank = spark.createDataFrame(rows, "id long, v array<double>")
    queries = spark.createDataFrame(asked, "qid long, q array<double>")
    got = dict(V.near_duplicate_gate(queries, bank, lists=32, probes=3).collect())
    assert len(got) == len(asked) and got[20_000] and got[20_001]
    assert sum(not got[10_000 + i] for i in range(400)) >= 0.9 * 400
    centres = V.train_centroids(bank, 32)
    pairs = V.probed(queries, centres, 3).join(V.inverted_lists(bank.where("id < 400"), centres), "list").count()
    assert pairs <= 0.1 * 400 * 400 + 400 * 400 * 0.05
    small = V.train_centroids(bank.limit(0), 32)
    assert V.inverted_lists(bank.limit(0), small).count() == 0
    assert dict(V.near_duplicate_gate(queries.limit(3), bank.limit(0)).collect()) == {10_000: True, 10_001: True, 10_002: True}


def test_index_deals_large_lists_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 50)
    monkeypatch.setattr(V, "QUERY_ROWS", 20)
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)], "id long, v array<double>")
    q = v.where("id % 7 = 0").toDF("qid", "q")
    exact = {(r.qid, r.id) for r in V.cosine_top_k(q, v, 5).collect()}
    assert {(r.qid, r.id) for r in V.approximate_top_k(q, v, 5, lists=2, probes=2).collect()} == exact


def test_trust(spark):
    df = spark.createDataFrame([(1, 5), (20, 20), (0, 0), (None, None)], "c int, n int")
    assert [round(r[0], 6) for r in df.select(L.trust(F.col("c"), F.col("n"))).collect()] == [0.1, 1.0, 0.3, 0.3]


def test_rate_limit(spark):
    rows = spark.range(21).select(F.lit(1).alias("session"), F.to_timestamp(F.lit("2024-01-01 00:30:00")).alias("ts"))
    assert L.hourly(rows).first()["rejected"] == 1


def test_votes_beyond_the_limit_are_rejected(spark, tmp_path):
    import os

    times = ["12:00:05", "12:59:00", "12:10:00", "12:10:00", "13:00:00", "12:20:00"]
    rows = [(s, "db", f"q{i}", "up", f"2024-01-01 {x}") for s in (1, 2) for i, x in enumerate(times)]
    df = spark.createDataFrame(rows, "session int, db string, query string, verdict string, t string").select("session", "db", "query", "verdict", F.to_timestamp("t").alias("ts"))
    got = {(r.session, r.query) for r in L.admitted(df, 3).collect()}
    assert got == {(s, f"q{i}") for s in (1, 2) for i in (0, 2, 3, 4)}
    for k in range(3):  # the second and third file come later and find the hour as full as it is
        df.where(f"int(substring(query, 2, 1)) div 2 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            os.makedirs(tmp_path / "all", exist_ok=True)
            os.rename(f, tmp_path / "all" / f"{k}.parquet")
            os.utime(tmp_path / "all" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    got = {(r.session, r.query) for r in L.drained(L.admitted(stream, 3), "append").collect()}
    assert got == {(s, f"q{i}") for s in (1, 2) for i in (0, 1, 2, 4)}


def test_scores_are_made_in_small_matrices(spark, monkeypatch):
    """A matrix of scores takes 8 MB at most, and the parts of a block give what the whole gives."""
    assert V.CHUNK_ROWS * V.BLOCK_ROWS * 8 <= 8 << 20
    parts = [F.cos(F.col("id") * i).cast("float") for i in (1, 2, 5)]
    v = spark.range(90).select("id", F.when(F.col("id") % 30 == 7, F.array(*[F.lit(0).cast("float")] * 3)).otherwise(F.array(*parts)).alias("v"))
    q = v.where("id % 2 = 1").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    whole = sorted(V.cosine_top_k(q, v, 4).collect())
    monkeypatch.setattr(V, "CHUNK_ROWS", 7)
    assert sorted(V.cosine_top_k(q, v, 4).collect()) == whole and len(whole) == 42 * 4
    assert sorted(V.cosine_top_k(q.withColumn("q", F.col("q").cast("array<double>")), v, 4).collect()) == whole


def test_pairs_go_to_as_many_tasks_as_rows_need(spark, sf_dir, monkeypatch):
    from tessella.queries import registry

    monkeypatch.setattr(registry, "TASK_ROWS", 100)
    t = registry.Tables(spark, sf_dir)
    assert t.pairs.rdd.getNumPartitions() == -(-t.lineitem.count() // 100)


def test_many_sessions_share_few_states(spark, tmp_path):
    """As many rows as by the batch form, in calls of Python that sessions share."""
    ids = F.when(F.col("id") % 1001 < 1000, F.col("id") % 1001)  # one of the sessions has no name
    rows = spark.range(4004).select(ids.alias("session"), F.lit("db").alias("db"), F.col("id").cast("string").alias("query"), F.lit("up").alias("verdict"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 3600).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "votes"))
    stream = L.admitted(L.source(spark, str(tmp_path / "votes"), rows.schema), 3)
    got = L.drained(stream, "append")
    assert sorted(got.collect(), key=str) == sorted(L.admitted(rows, 3).collect(), key=str) and got.count() == 3003
    states = [q for q in spark.streams.active if q.isActive]
    assert not states and "__bucket" in stream._jdf.queryExecution().logical().toString()


def test_lives(spark):
    day = lambda n: F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(F.lit(n))
    rows = lambda *days: spark.range(1).select(F.explode(F.array(*[day(n) for n in days])).alias("ts"))
    seen = L.first_seen(rows(0, 7, 14, 30).withColumns({"db": F.lit("d"), "query": F.lit("q")}))
    assert sorted(str(r.first_ts)[:10] for r in seen.collect()) == ["2024-01-01", "2024-01-31"]
    judged = rows(0, 10, 150, 160).withColumns({"session": F.lit(1), "correct": F.col("ts") > "2024-03-01"})
    assert [tuple(r)[:3] for r in L.session_trust(judged).collect()] == [(1, 2, 2)]
    assert L.session_trust(judged, "2024-08-15").count() == 1 and L.session_trust(judged, "2024-10-15").count() == 0


def test_promotion(spark):
    """Downvotes that a judge confirms make a session trusted; what is near the bank is not promoted."""
    ts = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    votes = spark.range(9).select((F.col("id") % 3).alias("session"), F.lit("db").alias("db"), F.concat(F.lit("q"), F.floor(F.col("id") / 3)).alias("query"), F.lit("up").alias("verdict"), ts.alias("ts"))
    judged = spark.range(60).select((F.col("id") % 3).alias("session"), F.lit(True).alias("correct"), ts.alias("ts"))
    trusts = L.session_trust(judged)
    assert all(r.trust == 1.0 for r in trusts.collect())
    near = spark.createDataFrame([("db", "q1")], "db string, query string")
    assert {r["query"] for r in L.promoted(votes, trusts, "2024-01-04", near=near).collect()} == {"q0", "q2"}
    assert L.promoted(votes, trusts, "2024-01-02").count() == 0 and L.promoted(votes, trusts.limit(0), "2024-01-04").count() == 0


def test_partners_and_synonyms(spark):
    refs = [("f", "gene_id", "m", "id"), ("f", "partner_id", "m", "id"), ("g", "partner_id", "m", "id"), ("f", "partner_x", "k", "id")]
    assert C.partner_keys(refs) == [refs[1]]
    rows = spark.createDataFrame([("Alpha", ["a", "z", "beta"]), ("Beta", ["b", "z ", None]), ("Gamma", None)], "name string, s array<string>")
    assert sorted(map(tuple, C.synonym_map(rows, "name", "s").collect())) == [("a", "Alpha"), ("b", "Beta")]


def test_stream_equals_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    judge = lambda df: df.select(F.col("user_id").alias("session"), (F.col("value") > 50).alias("correct"), F.col("ts").cast("timestamp").alias("ts"))
    stream = L.drained(L.session_trust(judge(L.source(spark, f"{sf_dir}/events.parquet*", events.schema))))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, L.session_trust(judge(events)).collect()))


def test_late_rows_are_left_out(spark, tmp_path):
    """An hour that the watermark has closed takes no more rows."""
    import os

    for k, ts in enumerate(["2024-01-01 12:00:00", "2024-01-02 12:00:00", "2024-01-02 13:00:00", "2024-01-01 12:30:00", "2024-01-03 12:00:00", "2024-01-03 13:00:00"]):
        rows = spark.range(1).select(F.lit(1).alias("session"), F.to_timestamp(F.lit(ts)).alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            os.makedirs(tmp_path / "all", exist_ok=True)
            os.rename(f, tmp_path / "all" / f"{k}.parquet")
            os.utime(tmp_path / "all" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("session int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    got = {str(r.hour): r.n for r in L.drained(L.hourly(stream), "append").collect()}
    assert got == {"2024-01-01 12:00:00": 1, "2024-01-02 12:00:00": 1, "2024-01-02 13:00:00": 1}


def test_funnel_and_retry(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "n string, i int")
    plan = spec.StarPlan({"t": None}, outputs=("i",))
    got = star.run({"t": df}, plan, {"n": ["z"]}, on_empty=lambda f: {"n": ["B"]})
    assert [tuple(r) for r in got.rows.collect()] == [(2, "b")]
    assert got.funnel.first()["rows_before"] == 3 and got.funnel.first()["rows_after"] == 1


def star_of(spark):
    a = spark.createDataFrame([(i, i % 3 if i else None) for i in range(40)], "id int, k int")
    b = spark.createDataFrame([(i % 2, i) for i in range(6)] + [(None, 1)], "k2 int, v int")
    c = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (4, "z")], "v3 int, name string")
    joins = (spec.JoinEdge("a", "b", ("k",), ("k2",)), spec.JoinEdge("b", "c", ("v",), ("v3",)))
    return {"a": a, "b": b, "c": c}, spec.StarPlan(parents={"a": None, "b": "a", "c": "b"}, joins=joins, outputs=("id", "name"))


@pytest.mark.parametrize("decorations", [(), ("c",), ("b", "c")])
def test_observed_joins(spark, decorations):
    """One run counts its joins as their histograms do, the guard's own counts left out; rows are the same."""
    from dataclasses import replace

    catalog, plan = star_of(spark)
    plan = replace(plan, decorations=frozenset(decorations), require_all={"name": ["X", "y"]}, tie_breakers=("v",), rank=(("k", True),))
    plain, seen = (star.run(catalog, plan, {"name": ["x", "Y"]}, observe=o, most_rows=200) for o in (False, True))
    assert list(map(tuple, seen.joins.collect())) == sorted(map(tuple, plain.joins.collect()))
    assert seen.rows.collect() == plain.rows.collect() and plain.rows.count() > 0


def test_observed_joins_of_empty_sides(spark):
    """Where Spark leaves joins out since a side is empty, they are counted from the histograms."""
    catalog, plan = star_of(spark)
    got = star.run({**catalog, "b": catalog["b"].limit(0)}, plan, {"name": ["x"]}, observe=True)
    assert sorted(map(tuple, got.joins.collect())) == [(1, "b", 40, 0), (2, "c", 0, 0)] and got.rows.count() == 0
    lone = star.run({"a": catalog["a"]}, spec.StarPlan({"a": None}, outputs=("id",)), {"k": ["1"]}, observe=True)
    assert lone.joins is None and lone.rows.count() == 40


def test_sort_keys(spark):
    df = spark.createDataFrame([(1, "odd", "q", 5.0), (2, "Approved", "q", 1.0), (3, "Phase 2", "BINDING a", 2.0), (4, "Phase 2", None, None), (5, "Phase 2", "q", 3.0), (6, None, "binds", 9.0)], "i int, v string, a string, s double")
    sort = (spec.SortKey("nowhere"), spec.SortKey("v", order=("Approved", "Phase 2")), spec.SortKey("a", contains_first=("bind",)))
    plan = spec.StarPlan({"t": None}, outputs=("i", "v", "a"), rank=(("s", True),), sort=sort)
    got = star.run({"t": df}, plan, {"i": "requested", "v": ["odd", "approved", "phase 2"]}).rows
    assert [r.i for r in got.collect()] == [2, 3, 5, 4, 1]
    assert [r.i for r in df.orderBy(*star.ordering([], df.columns, (spec.SortKey("s", descending=True),))).collect()] == [6, 1, 5, 3, 2, 4]


XML = """<?xml version="1.0" encoding="UTF-8"?>
<JDBOR><DisorderList count="4">
<Disorder id="1"><Name lang="en"> </Name><Name lang="en">Alpha é</Name><SynonymList count="2"><Synonym lang="en">A &amp; B</Synonym><Synonym lang="en"> alpha é </Synonym></SynonymList></Disorder>
<Disorder id="2">
  <Name lang="en">Beta</Name><SynonymList><Synonym lang="en">a &amp; b</Synonym><Synonym/></SynonymList>
</Disorder><Disorder id="3"/><Disorder><Name></Name><SynonymList><Synonym>lost</Synonym></SynonymList></Disorder><Disorder><Name>Gamma</Name></Disorder>
</DisorderList></JDBOR>
"""
TEXTS = "array<struct<_VALUE:string,_lang:string>>"


def test_xml_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    rows = C.xml_rows(spark, str(tmp_path), "Disorder", f"_id int, Name {TEXTS}, SynonymList struct<Synonym:{TEXTS}>")
    got = {r.alias: r.canonicals for r in C.alias_lists(rows, F.col("Name._VALUE"), F.col("SynonymList.Synonym._VALUE")).collect()}
    assert got == {"alpha é": ["Alpha é"], "a & b": ["Alpha é", "Beta"], "beta": ["Beta"], "gamma": ["Gamma"]}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "b.xml").write_text("<DisorderList></DisorderList>")
    assert C.xml_rows(spark, str(tmp_path / "empty"), "Disorder", "_id int").count() == 0


def test_tasks_share_a_large_xml_file(spark, tmp_path):
    """Wherever a file is cut, each element is read once, as by the reader of whole files."""
    body = "".join(f'<Disorder id="{i}"><Name lang="en">{"n" * (i % 97)} é{i}</Name></Disorder>{" " * (i % 7)}\n' for i in range(2000))
    (tmp_path / "a.xml").write_text(f"<List>{body}</List>")
    schema = f"_id int, Name {TEXTS}"
    whole = sorted(r._id for r in spark.read.format("xml").option("rowTag", "Disorder").schema(schema).load(str(tmp_path)).collect())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3001b")
    try:
        rows = C.xml_rows(spark, str(tmp_path), "Disorder", schema)
        assert rows.rdd.getNumPartitions() > 20
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(r._id for r in got) == whole == list(range(2000)) and all(r.Name[0]._VALUE.endswith(f"é{r._id}") for r in got)


def test_full_names_are_the_same_again(spark):
    lookup = spark.createDataFrame([("s", "b"), ("s", "a"), (None, "n")], "s string, f string")
    df = spark.createDataFrame([("s",), (None,), ("t",)], "c string")
    assert sorted(map(tuple, C.full_names(df, lookup, "s", "f", ["c"]).collect()), key=str) == [("s", "a"), ("t", None), (None, None)]


BANK = "db string, stage string, question string, answer int"


def held(spark, folder, schema):
    return sorted((r.db, r.stage, r.question, r.answer) for r in B.read(spark, folder, schema).collect())


def test_examples_of_the_bank(spark):
    rows = spark.createDataFrame([(" TTD ", "a", " q ", 1), ("ttd", "a", "q", 0), ("ttd", "b", " ", 1), (None, "a", "q", 1), ("ttd", None, "q", 1), ("ttd", "c", "q", None)], BANK)
    got = B.one_per_id(B.examples(rows, ("a", "b")))
    assert [(r.db, r.stage, r.question, r.answer) for r in got.collect()] == [("ttd", "a", "q", 0)]
    assert B.examples(rows).count() == 3


def test_deliveries_to_the_bank(spark, tmp_path):
    """A slice is replaced, others stay, and what comes again changes nothing."""
    folder = str(tmp_path / "bank")
    make = lambda *rows: B.examples(spark.createDataFrame(list(rows), BANK))
    old = make(("d", "a", "q1", 1), ("d", "a", "q2", 2), ("d", "b", "q1", 3), ("1", "2", "q", 4))
    assert B.deliver(old, folder, "s", 0) and not B.deliver(old, folder, "s", 0)
    assert B.deliver(make(("d", "a", "q3", 5)), folder, "s", 1) and not B.deliver(old, folder, "s", 0)
    assert held(spark, folder, old.schema) == [("1", "2", "q", 4), ("d", "a", "q3", 5), ("d", "b", "q1", 3)]
    assert B.deliver(old.limit(0), folder, "s", 2) and B.deliver(make(("d", "b", "q1", 6)), folder, "other", 0)
    assert held(spark, folder, old.schema) == [("1", "2", "q", 4), ("d", "a", "q3", 5), ("d", "b", "q1", 6)]


@pytest.mark.parametrize("step", ["replace", "note"])
def test_a_stream_to_the_bank_that_is_cut_off(spark, tmp_path, monkeypatch, step):
    """Cut off before its slices, or between them and the note, a delivery comes again; the bank is as if nothing had been."""
    import os

    (tmp_path / "in").mkdir()
    deliveries = [[("d", "a", f"q{i}", i) for i in range(5)] + [("d", "b", "q", 0)], [("d", "a", "q1", 7)], [("d", "b", "q", 8), ("e", "a", "q", 9)]]
    for k, rows in enumerate(deliveries):
        spark.createDataFrame(rows, BANK).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        (f,) = (tmp_path / f"in{k}").glob("*.parquet")
        os.rename(f, tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = B.examples(spark.readStream.schema(BANK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    folder, state, own, calls = str(tmp_path / "bank"), str(tmp_path / "state"), getattr(B, step), []

    def cut(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return own(*args)

    monkeypatch.setattr(B, step, cut)
    with pytest.raises(Exception, match="lost"):
        B.feed(stream, folder, "s", state).awaitTermination()
    assert B.last_epoch(spark, folder, "s") == 0
    B.feed(stream, folder, "s", state).awaitTermination()
    assert held(spark, folder, stream.schema) == [("d", "a", "q1", 7), ("d", "b", "q", 8), ("e", "a", "q", 9)]
    assert B.last_epoch(spark, folder, "s") == 2 and len(calls) == 4


def test_expression_rows_are_made_once(spark, sf_dir):
    from tessella.queries import QUERIES

    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "jsontostructs" not in plan("json_expression") and "from_json" not in plan("json_expression")  # the sort reads stored rows
    assert plan("json_flatten_fallback").count("Exchange hashpartitioning") == 1  # an order's rows are shuffled once
