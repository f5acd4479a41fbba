"""Personal data, by form and by what surrounds it (operator 5), in DataFrame functions only.

Four kinds are found by their form: email, ip, card (with its check digit) and phone. Beyond these, the
sanitisation is information-theoretic: for a protected entity c (a found value) and a term t within WINDOW
characters of it, counts over all texts give the information content IC(c) = -log p(c) and the pointwise mutual
information PMI(c, t). Where PMI / IC reaches DISCLOSURE, seeing the term tells nearly as much as seeing the entity
itself, and the term becomes a span of kind term wherever it stands, in whatever text. PMI must be significant:
n texts with both have a chance of at most exp(-n (PMI - 1)), which must stay below ALPHA over the number of pairs
that are looked at. `sanitise` replaces spans by their kind.

Offsets count code points. The possessive forms below find what the plain ones find: a run that a
failing attempt has passed cannot succeed from a later start, so starts inside a run are skipped and no form
backtracks over a long run. Places come from running sums that are made by doubling, and replaced texts from pieces of
UTF-32, so that work grows with a text and its matches (times a logarithm).

Edge cases: null and empty texts have no spans; repeated rows are scanned each; null ids are fine, as rows
meet their terms by id and text; an empty table gives an empty result; extra columns pass through
`sanitise`, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Kinds and their forms. Card numbers need 12 digits in a run to be worth a look.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(FORMS)
#: What a text must hold to be worth the search.
HINTS = {"email": "@", "phone": "+"}
#: Words, and words that a slice with a character more at either end holds whole.
WORD = r"\p{L}{2,}+"
TERM = r"(?<=\P{L})\p{L}{2,}+(?=\P{L})"
WINDOW, DISCLOSURE, ALPHA = 80, 0.97, 0.01
#: Arrays have fewer than 2^30 elements.
SHIFTS = ", ".join(str(1 << k) for k in range(30))


def quoted(form: str) -> str:
    return "r'" + form + "'"


def running(array: str, op: str) -> str:
    """SQL of the running sums (op: x + y) or maxima (op: greatest(x, y)) of an array column, each with its own: the reach of
    every place doubles until it is the whole."""
    step = op.replace("y", "acc[i - s]")
    return f"aggregate(filter(array({SHIFTS}), s -> s < size({array})), {array}, (acc, s) -> transform(acc, (x, i) -> if(i >= s, {step}, x)))"


def located(df: DataFrame, searches: dict[str, tuple[str, str]]) -> DataFrame:
    """df with `__s_<name>` for each search (condition, form) in `__t`: array<struct<s, e, v>> of its matches. Arrays meet as
    arguments, never as columns inside a lambda, where the optimiser may put what makes them, once for each element."""
    rest = df.columns
    for n, (when, form) in searches.items():
        df = df.withColumn(f"__h_{n}", F.expr(f"if({when}, regexp_extract_all(__t, {quoted(form)}, 0), cast(array() as array<string>))"))
    for n, (_, form) in searches.items():
        df = df.withColumn(f"__p_{n}", F.expr(f"if(size(__h_{n}) > 0, split(__t, {quoted(form)}, -1), cast(array() as array<string>))"))
    for n in searches:
        df = df.withColumn(f"__l_{n}", F.expr(f"zip_with(__h_{n}, slice(__p_{n}, 1, size(__h_{n})), (x, p) -> cast(length(x) + length(p) as bigint))"))
    for n in searches:
        df = df.withColumn(f"__e_{n}", F.expr(running(f"__l_{n}", "x + y")))
    for n in searches:
        df = df.withColumn(f"__s_{n}", F.expr(f"zip_with(__h_{n}, __e_{n}, (x, e) -> named_struct('s', e - length(x), 'e', e, 'v', x))"))
    return df.select(*rest, *[f"__s_{n}" for n in searches])


def valid(kind: str, v: str) -> str:
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"forall(split({v}, '[.]'), x -> coalesce(try_cast(concat('0', regexp_replace(x, '^0+', '')) as bigint), 256) <= 255)",
        "card": f"length({digits}) between 12 and 19 and luhn_check({digits})",
        "phone": f"length({digits}) between 9 and 15",
    }[kind]


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and more of docs with `__t` (its text, null: empty), h (its hash) and spans,
    array<struct<s, k, e, v>>: base spans by start, then kind (its number)."""
    df = docs.withColumn("__t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = located(df, {k: (f"contains(__t, '{HINTS[k]}')" if k in HINTS else "true", form) for k, form in FORMS.items()})
    each = [f"transform(filter(__s_{k}, x -> {valid(k, 'x.v')}), x -> named_struct('s', x.s, 'k', {n}, 'e', x.e, 'v', x.v))" for n, k in enumerate(KINDS)]
    df = df.withColumn("spans", F.expr(f"array_sort(concat({', '.join(each)}))")).withColumn("h", F.xxhash64("__t"))
    return df.drop(*[f"__s_{k}" for k in KINDS])


def contexts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, h, spans array<struct<s, k, e, v>>, around array<struct<k, v, t>>) for each row of docs: terms beside its spans.
    row tells rows apart that repeat."""
    found = with_spans(docs.select("doc_id", "text"))
    # Padded by a character at either end; 4 bytes a character, so that slices cost what they hold.
    found = found.withColumn("__b", F.expr("if(size(spans) > 0, encode(concat(' ', __t, ' '), 'UTF-32'), null)"))
    left = f"decode(substring(b, cast(4 * greatest(x.s - {WINDOW}, 0L) + 1 as int), cast(4 * (least(x.s, {WINDOW}L) + 2) as int)), 'UTF-32')"
    right = f"decode(substring(b, cast(4 * x.e + 1 as int), {4 * (WINDOW + 2)}), 'UTF-32')"
    words = f"array_union(regexp_extract_all({left}, {quoted(TERM)}, 0), regexp_extract_all({right}, {quoted(TERM)}, 0))"
    # A binary column inside a lambda is copied whole for each element; as an element of an array it is not.
    around = f"flatten(flatten(transform(array(__b), b -> transform(spans, x -> transform({words}, t -> named_struct('k', x.k, 'v', x.v, 't', lower(t)))))))"
    return materialise(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h", "spans", F.expr(around).alias("around")), "contexts")


def words_of(docs: DataFrame) -> DataFrame:
    """(doc_id, h, t): each row's different words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), F.explode(words).alias("t"))


def disclosing_terms(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(t): the terms that disclose an entity, from `contexts` and the words of all texts. All counts are of rows, so that
    a corpus with its rows repeated has the same terms; what is significant depends on how many different texts say so.

    An entity with a third of all rows is only ever counted by partial sums; words are joined with the terms in question
    before they are counted, by a join that Spark picks by their size."""
    near = found.where("size(around) > 0").select("row", "h", F.explode("around").alias("x")).select("row", "h", "x.*").distinct()
    pairs = near.groupBy("k", "v", "t").agg(F.countDistinct("h").alias("texts"), F.count("*").alias("n_ct")).where("texts >= 2")
    entities = found.where("size(spans) > 0").select("row", F.explode("spans").alias("x")).select("row", "x.k", "x.v").distinct()
    entities = entities.groupBy("k", "v").agg(F.count("*").alias("n_c")).where("n_c >= 2")
    pairs = materialise(pairs.join(entities, ["k", "v"]), "pairs")
    terms = materialise(pairs.select("t").distinct(), "asked")
    counts = words_of(docs).join(terms, "t").groupBy("t").agg(F.count("*").alias("n_t"))
    total, tests = float(found.count()), float(max(1, pairs.count()))
    ic = F.log(F.greatest(F.lit(total) / F.col("n_c"), F.lit(1.0 + 1e-9)))
    pmi = F.log(F.least(F.col("n_ct") / F.col("n_t"), F.lit(1.0))) + ic
    sure = F.col("texts") * (pmi - 1) >= F.log(F.lit(tests / ALPHA))
    return materialise(pairs.join(counts, "t").where((pmi / ic >= DISCLOSURE) & sure).select("t").distinct(), "disclosing")


def placed_terms(docs: DataFrame, told: DataFrame) -> DataFrame:
    """(doc_id, h, terms array<struct<s, e>>) of the rows that hold disclosing terms; what touches a base span is covered by it."""
    own = materialise(words_of(docs).join(told, "t").groupBy("doc_id", "h").agg(F.collect_set("t").alias("told")), "told")
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    rows = rows.alias("d").join(own.alias("o"), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.h") == F.col("o.h"))).select("d.doc_id", "d.text", "o.told")
    df = located(with_spans(rows), {"w": ("true", WORD)})
    hits = "transform(filter(__s_w, x -> array_contains(told, lower(x.v))), x -> named_struct('s', x.s, 'b', 1, 'e', x.e))"
    df = df.withColumn("__m", F.expr(f"array_sort(concat(transform(spans, x -> named_struct('s', x.s, 'b', 0, 'e', x.e)), {hits}))"))
    # The end of all base spans before each, and the start of the next one behind it.
    df = df.withColumn("__a", F.expr("transform(__m, x -> if(x.b = 0, x.e, 0L))")).withColumn("__z", F.expr("reverse(transform(__m, x -> if(x.b = 0, -x.s, -9223372036854775807L)))"))
    df = df.withColumn("__a", F.expr(running("__a", "greatest(x, y)"))).withColumn("__z", F.expr(f"reverse({running('__z', 'greatest(x, y)')})"))
    free = "filter(zip_with(zip_with(__m, __a, (x, a) -> named_struct('x', x, 'a', a)), __z, (y, z) -> named_struct('s', y.x.s, 'e', y.x.e, 'free', y.x.b = 1 and y.a <= y.x.s and -z >= y.x.e)), x -> x.free)"
    terms = f"transform({free}, x -> named_struct('s', x.s, 'e', x.e))"
    return materialise(df.select("doc_id", "h", F.expr(terms).alias("terms")).dropDuplicates(["doc_id", "h"]), "placed")


def with_terms(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """rows (doc_id, h and more) with their terms."""
    same = F.col("f.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("f.h") == F.col("p.h"))
    joined = rows.alias("f").join(placed.alias("p"), same, "left")
    return joined.select("f.*", F.coalesce("p.terms", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")).alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<s, k, e, v>>, terms array<struct<s, e>>) for each row of docs."""
    docs = docs.select("doc_id", "text")
    found = contexts(docs)
    return with_terms(found.select("doc_id", "h", "spans"), placed_terms(docs, disclosing_terms(found, docs))).drop("h")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with each span in its text replaced by its kind; overlapping spans go together."""
    placed = placed_terms(docs, disclosing_terms(contexts(docs), docs))
    df = with_terms(with_spans(docs.select("doc_id", "text", F.struct("*").alias("row"))), placed)
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    marks = f"array_sort(concat(transform(spans, x -> named_struct('s', x.s, 'e', x.e, 'n', array({names})[x.k])), transform(terms, t -> named_struct('s', t.s, 'e', t.e, 'n', '[TERM]'))))"
    df = df.withColumn("__marks", F.expr(marks)).withColumn("__ends", F.expr("transform(__marks, x -> x.e)"))
    df = df.withColumn("__ends", F.expr(running("__ends", "greatest(x, y)"))).withColumn("__b", F.expr("if(size(__marks) > 0, encode(__t, 'UTF-32'), null)"))
    # What stands between the end of all marks before and a mark, and the mark's name; marks inside others add nothing.
    gaps = "zip_with(__marks, slice(concat(array(0L), __ends), 1, size(__marks)), (x, p) -> named_struct('s', x.s, 'n', x.n, 'p', p))"
    df = df.withColumn("__gaps", F.expr(gaps))
    piece = "if(x.s >= x.p, concat(decode(substring(b, cast(4 * x.p + 1 as int), cast(4 * (x.s - x.p) as int)), 'UTF-32'), x.n), '')"
    rest = "decode(substring(__b, cast(4 * element_at(__ends, -1) + 1 as int)), 'UTF-32')"
    clean = f"if(size(__marks) = 0, text, concat(array_join(flatten(transform(array(__b), b -> transform(__gaps, x -> {piece}))), ''), {rest}))"
    return df.withColumn("row", F.col("row").withField("text", F.expr(clean))).select("row.*")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    base = f"transform(spans, x -> named_struct('s', x.s, 'k', x.k, 'l', concat_ws(':', array({kinds})[x.k], x.s, x.e)))"
    added = f"transform(terms, t -> named_struct('s', t.s, 'k', {len(KINDS)}, 'l', concat_ws(':', 'term', t.s, t.e)))"
    line = "array_join(transform({}, x -> x.l), ',')"
    found = found.withColumn("base", F.expr(base)).withColumn("every", F.expr(f"array_sort(concat(base, {added}))"))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.k = {n})) as bigint)").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(line.format("base")), 256).alias("base_sha256"), F.expr(line.format("every")).alias("spans"))
