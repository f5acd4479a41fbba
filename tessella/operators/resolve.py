"""Entity resolution: names against vocabularies, by exact, synonym, fuzzy and acronym matches.

Terms and vocabularies are DataFrames and meet in joins. The fuzzy scorer blocks pairs by shared trigrams or
words before it scores them, so that no term meets the whole vocabulary."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import acronym, camel_words, is_structural, match_key, safe_normalise, without_salt
from tessella.operators.lineage import checkpointed, spread, stored
from tessella.sources.curate import first_per_key


def exact_first(terms: DataFrame, pool: DataFrame) -> DataFrame:
    """(query, field, value): canonical spellings where every term of a field is in the pool, else nothing.
    terms: (query, field, term); pool: (field, value)."""
    low = pool.groupBy("field", F.lower("value").alias("__v")).agg(F.min("value").alias("value"))
    hit = terms.withColumn("__v", F.lower(F.trim("term"))).join(low, ["field", "__v"], "left")
    whole = hit.groupBy("query", "field").agg(F.bool_and(F.col("value").isNotNull()).alias("all")).where("all")
    return hit.join(whole.select("query", "field"), ["query", "field"], "left_semi").select("query", "field", "value").distinct()


def overlap(candidates: DataFrame, pool: DataFrame, protected: DataFrame) -> DataFrame:
    """(query, value): pool spellings that a candidate equals by match key; names of the protected list must
    be equal in normal form."""
    c = candidates.withColumn("__n", safe_normalise(F.col("term"))).withColumn("__k", match_key(F.col("term")))
    p = pool.withColumn("__n", safe_normalise(F.col("value"))).withColumn("__k", match_key(F.col("value")))
    names = protected.select(safe_normalise(F.col("name")).alias("__n")).distinct()
    strict = c.join(names, "__n", "left_semi").join(p.select("__n", "value"), "__n").select("query", "value")
    loose = c.join(names, "__n", "left_anti").join(p.join(names, "__n", "left_anti").select("__k", "value"), "__k").select("query", "value")
    return strict.union(loose).distinct()


def expansion(terms: DataFrame, synonyms: DataFrame, aliases: DataFrame, pool: DataFrame, protected: DataFrame) -> DataFrame:
    """(query, value): terms with their synonyms, those of the salt-free base and alias canonicals, reduced to
    what the pool has; where that leaves nothing of a query, all of it stays."""
    own = terms.select("query", "term")
    base = own.select("query", without_salt(F.col("term")).alias("term")).where("term is not null")
    keyed = own.union(base).withColumn("__k", F.lower("term"))
    syn = keyed.join(synonyms.select(F.lower("name").alias("__k"), "synonym"), "__k").select("query", F.col("synonym").alias("term"))
    ali = keyed.join(aliases.select(F.lower("alias").alias("__k"), "canonical"), "__k").select("query", F.col("canonical").alias("term"))
    every = own.union(base).union(syn).union(ali).distinct()
    kept = overlap(every, pool, protected)
    bare = every.join(kept.select("query").distinct(), "query", "left_anti").select("query", F.col("term").alias("value"))
    return kept.union(bare)


def alias_map(aliases: DataFrame, canonicals: DataFrame, active: DataFrame) -> DataFrame:
    """(alias, canonical): of aliases (id, alias) and canonicals (id, canonical), those whose id has facts,
    that mean one canonical only, differ from it beyond case and aren't another's canonical; no structural ids,
    nothing under two characters."""
    rows = aliases.where((F.length(F.trim("alias")) >= 2) & ~is_structural(F.col("alias"))).join(canonicals, "id").join(active.select("id").distinct(), "id", "left_semi")
    rows = rows.select(F.lower(F.trim("alias")).alias("alias"), "canonical").where(F.col("alias") != F.lower("canonical"))
    one = rows.groupBy("alias").agg(F.countDistinct("canonical").alias("n"), F.min("canonical").alias("canonical")).where("n = 1")
    return one.select("alias", "canonical").join(canonicals.select(F.lower("canonical").alias("alias")).distinct(), "alias", "left_anti")


def apply_aliases(values: DataFrame, maps: DataFrame) -> DataFrame:
    """values (query, field, value) with aliases replaced; a field uses the map of the longest field name it
    ends in. maps: (field, alias, canonical)."""
    fields = maps.select(F.col("field").alias("map_field")).distinct()
    ends = values.select("field").distinct().join(F.broadcast(fields), F.expr("endswith(field, map_field)"))  # field names: a few
    chosen = ends.groupBy("field").agg(F.max(F.struct(F.length("map_field"), "map_field")).alias("x")).select("field", "x.map_field")
    m = maps.select(F.col("field").alias("map_field"), F.lower("alias").alias("__a"), "canonical")
    out = values.join(chosen, "field", "left").withColumn("__a", F.lower(F.trim("value"))).join(m, ["map_field", "__a"], "left")
    return out.select("query", "field", F.coalesce("canonical", "value").alias("value"))


def reverse_map(names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(synonym, canonicals): every synonym, and every name itself, with all names it stands for."""
    rows = synonyms.join(names, "id").select(F.lower("synonym").alias("synonym"), "name").union(names.select(F.lower("name").alias("synonym"), "name"))
    return rows.groupBy("synonym").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("canonicals"))


def rewrite_phrases(c: Column, rewrites: list[tuple[str, str]]) -> Column:
    """Each source phrase becomes its target, unless the target stands there already."""
    from tessella.functions.predicates import quoted

    return reduce(lambda x, p: F.when(F.lower(x).contains(p[1].lower()), x).otherwise(F.regexp_replace(x, "(?i)" + quoted(p[0]), p[1])), rewrites, c)


#: What may stand round a phrase and stays: fixed values, before its first word and behind its last.
OPENING, CLOSING = "([{\"'", ".,;:!?)]}\"'"


def rewrite_ngrams(texts: DataFrame, dictionary: DataFrame, longest: int = 5) -> DataFrame:
    """texts (id, text) with `rewritten`: phrases of the dictionary (phrase, target) replaced, longest first, left to right, never
    overlapping; punctuation round a phrase stays. A phrase under several targets takes the smallest, one that is its target is
    left. Runs of up to `longest` words, and no longer ones than the dictionary has, meet it in a join, of whatever size it is. Of a text's matches those that overlap
    in a chain are chosen from together, in their order; the text is then put together from what stands between."""
    table = dictionary.select(F.lower("phrase").alias("core"), "target").where(F.col("core") != F.lower("target")).groupBy("core").agg(F.min("target").alias("target"))
    table = stored(table, "phrases")
    # A run of n words has n - 1 spaces, and so has what is left of it without punctuation.
    spaces = F.length("core") - F.length(F.replace("core", F.lit(" "), F.lit("")))
    most = min(longest, (table.agg(F.max(spaces)).first()[0] or 0) + 1)
    clean = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    rows = spread(texts.select("id", "text")).select(F.monotonically_increasing_id().alias("row"), "id", "text", F.when(clean != "", F.split(clean, " ")).alias("words"))
    rows = stored(rows, "texts")
    quoted = lambda chars: "[" + re.escape(chars) + "]*"
    # Neither goes beyond a word.
    heads = F.transform("words", lambda w: F.regexp_extract(w, "^" + quoted(OPENING), 0))
    tails = F.transform("words", lambda w: F.regexp_extract(w, quoted(CLOSING) + "$", 0))

    def phrases(i: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(most), F.size("words") - i))
        return F.transform(sizes, lambda n: F.struct(i.alias("i"), n.alias("n"), F.array_join(F.slice("words", i + 1, n), " ").alias("phrase"), F.get("heads", i).alias("head"), F.get("tails", i + n - 1).alias("tail")))

    runs = rows.where("words is not null").select("row", "words", heads.alias("heads"), tails.alias("tails"))
    runs = runs.select("row", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1), phrases))).alias("x")).select("row", "x.*")
    inner = F.length("phrase") - F.length("head") - F.length("tail")
    runs = runs.where(inner > 0).withColumn("core", F.lower(F.substring("phrase", F.length("head") + 1, inner))).drop("phrase")
    hits = runs.join(table, "core").groupBy("row", "i").agg(F.max_by(F.struct("n", F.concat("head", "target", "tail").alias("new")), "n").alias("x"))
    hits = hits.select("row", "i", (F.col("i") + F.col("x.n")).alias("end"), "x.new")
    # A match that begins behind all ends before it is always taken; the others depend on those of their chain.
    w = Window.partitionBy("row").orderBy("i")
    hits = hits.withColumn("chain", F.when(F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) <= F.col("i"), F.col("i")))
    hits = hits.withColumn("chain", F.last("chain", ignorenulls=True).over(w))
    chains = hits.groupBy("row", "chain").agg(F.array_sort(F.collect_list(F.struct("i", "end", "new"))).alias("hits"))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<i:int,end:int,new:string>>").alias("taken"))
    take = lambda acc, x: F.when(x.i >= acc.end, F.struct(x.end.alias("end"), F.array_append(acc.taken, x).alias("taken"))).otherwise(acc)
    chosen = chains.select("row", F.explode(F.aggregate("hits", none, take).taken).alias("x")).groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("taken"))
    found = rows.join(chosen, "row", "left").select("id", "text", F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.coalesce("taken", F.array().cast("array<struct<i:int,end:int,new:string>>")).alias("taken"))
    begins = F.slice(F.concat(F.array(F.lit(0)), F.transform("taken", lambda x: x.end)), 1, F.size("taken"))
    pieces = F.zip_with("taken", begins, lambda x, a: F.array_append(F.slice("words", a + 1, x.i - a), x.new))
    last = F.when(F.size("taken") > 0, F.get("taken", F.size("taken") - 1).end).otherwise(0)
    every = F.concat(F.flatten(pieces), F.slice("words", last + 1, F.size("words")))
    return found.select("id", "text", F.when(F.col("text").isNotNull(), F.array_join(every, " ")).alias("rewritten"))


def char_counts(c: Column) -> Column:
    """Sorted characters; two texts share as many as their multisets have in common."""
    return F.array_sort(F.split(c, ""))


def quick_ratio(a: Column, b: Column) -> Column:
    """2 x common characters / total length, for texts a and b."""
    chars = F.array_union(F.array_distinct(F.split(a, "")), F.array())
    of = lambda s, ch: F.length(s) - F.length(F.replace(s, ch, F.lit("")))
    common = F.aggregate(F.filter(chars, lambda ch: ch != ""), F.lit(0), lambda acc, ch: acc + F.least(of(a, ch), of(b, ch)))
    return F.when(F.length(a) + F.length(b) > 0, 2.0 * common / (F.length(a) + F.length(b))).otherwise(F.lit(1.0))


def prescreen(pairs: DataFrame, k: int) -> DataFrame:
    """(query, value, score): of pairs (query, term, value) the k best by containment, shared characters and words."""
    t, v = F.lower(F.trim("term")), F.lower("value")
    contains = F.when(v.contains(t) | t.contains(v), 1.0).otherwise(0.0)
    a, b = F.array_distinct(F.split(t, r"\s+")), F.array_distinct(F.split(v, r"\s+"))
    words = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
    scored = pairs.withColumn("score", F.round(2.0 * contains + quick_ratio(t, v) + 0.5 * words, 6))
    from pyspark.sql.window import Window

    w = Window.partitionBy("query").orderBy(F.desc("score"), "value")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("query", "value", "score")


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", " "), r"\s+", " "))


def acronym_filter(terms: DataFrame) -> DataFrame:
    """terms (query, name, term): those that stand for the name. Equal, all of its words, its acronym, an
    acronym with digits; all of a set in which a one-word name of three characters is listed."""
    q, t = plain(F.col("name")), plain(F.col("term"))
    rows = terms.where(F.trim("term") != "").withColumn("q", q).withColumn("t", t)
    single = ~F.col("q").contains(" ")
    listed = rows.where(single & (F.length("q") >= 3) & (F.col("t") == F.col("q"))).select("query").distinct()
    trusted = rows.join(listed, "query", "left_semi").select("query", F.trim("term").alias("term"))
    rest = rows.join(listed, "query", "left_anti").where(F.col("t") != "")
    qw, tw = F.split("q", " "), F.split("t", " ")
    q_acr = acronym(F.col("q"))
    equal = (F.col("t") == F.col("q")) | ((q_acr != "") & (F.col("t") == q_acr))
    every = F.size(F.array_except(qw, tw)) == 0
    short = single & (F.length("q") <= 6)
    prefix = lambda n: acronym(F.array_join(F.slice(tw, F.lit(1), n), " "))
    spelled = short & ((acronym(F.col("t")) == F.col("q")) | ((F.length("q") >= 3) & (prefix(F.greatest(F.length("q"), F.lit(1))) == F.col("q"))))
    letters, digits = F.regexp_replace("q", "[0-9]", ""), F.filter(F.split(F.regexp_replace("q", "[^0-9]", ""), ""), lambda d: d != "")
    mixed = short & F.col("q").rlike("[0-9]") & (letters != "") & ((acronym(F.col("t")) == letters) | (prefix(F.greatest(F.length(letters), F.lit(1))) == letters)) & F.forall(digits, lambda d: F.col("t").contains(d))
    kept = rest.where(equal | every | spelled | mixed).select("query", F.trim("term").alias("term"))
    return trusted.union(kept).distinct()


def family(names: DataFrame, keyword: str) -> DataFrame:
    """Names whose family text has the keyword, its plural or its singular, as whole words."""
    from tessella.functions.predicates import whole_word

    return names.where(whole_word("family", [keyword])).select("name").distinct()


def canonical_hit(hits: DataFrame) -> DataFrame:
    """hits (query, term, name, pos): the shortest exact name; else the shortest of those that hold the term
    as whole words and the hit at the first position."""
    t, n = F.lower(F.trim("term")), F.lower(F.trim("name"))
    word = F.concat(F.lit(" "), F.regexp_replace(n, "[^a-z0-9]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.regexp_replace(t, "[^a-z0-9]+", " "), F.lit(" ")))
    first = first_per_key(hits, ["query"], [F.asc("pos")]).select("query", F.col("pos").alias("__p"))
    rows = hits.join(first, "query").withColumn("tier", F.when(n == t, 0).when(word | (F.col("pos") == F.col("__p")), 1))
    best = first_per_key(rows.where("tier is not null"), ["query"], [F.asc("tier"), F.asc(F.length(n)), F.asc("pos")])
    return best.select("query", "name", "tier")


def literal_members(terms: DataFrame, members: DataFrame) -> DataFrame:
    """(query, name): members that equal the term or hold it as whole words. They meet by the term's first
    word, then the whole term is looked up."""
    words = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))
    t = terms.withColumn("t", words(F.col("term"))).withColumn("w", F.split("t", " ")[0])
    m = members.withColumn("n", words(F.col("name"))).withColumn("w", F.explode(F.array_distinct(F.split("n", " "))))
    return t.join(m, "w").where(F.concat(F.lit(" "), "n", F.lit(" ")).contains(F.concat(F.lit(" "), "t", F.lit(" ")))).select("query", "name").distinct()


def drop_foreign(synonyms: DataFrame, canonicals: DataFrame) -> DataFrame:
    """synonyms (id, synonym) without those that are another entity's canonical (id, canonical)."""
    other = canonicals.select(F.col("id").alias("__i"), F.lower("canonical").alias("__c"))
    return synonyms.join(other, (F.lower("synonym") == F.col("__c")) & (F.col("id") != F.col("__i")), "left_anti")


def canonical_fields(specs: DataFrame, source: str, canonical: str, skip: list[str] = []) -> DataFrame:
    """The source field fills an empty or requested canonical one, save for the databases of the skip list."""
    empty = F.col(canonical).isNull() | F.trim(canonical).isin("", "requested")
    filled = F.col(source).isNotNull() & ~F.trim(source).isin("", "requested")
    return specs.withColumn(canonical, F.when(empty & filled & ~F.col("db").isin(skip), F.col(source)).otherwise(F.col(canonical)))


def collection_aliases(values: DataFrame, name: str) -> DataFrame:
    """(alias, canonical): lower-case and CamelCase-split forms."""
    forms = F.array(F.lower(name), F.lower(camel_words(F.col(name))))
    return values.select(name).distinct().select(F.explode(F.array_distinct(forms)).alias("alias"), F.col(name).alias("canonical"))


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """(row, agree) of two tables (row, field, value): same fields with the same values, without regard to
    case or order."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("row", "field").agg(F.array_sort(F.collect_set(F.lower(F.trim("value")))).alias(name))

    both = keyed(left, "a").join(keyed(right, "b"), ["row", "field"], "full_outer")
    return both.groupBy("row").agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("agree"))


def kept_candidates(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (query, pos, value) that were chosen (query, value), first of each, in their spelling."""
    rows = candidates.withColumn("__v", F.lower(F.trim("value"))).join(chosen.select("query", F.lower(F.trim("value")).alias("__v")).distinct(), ["query", "__v"], "left_semi")
    return first_per_key(rows, ["query", "__v"], [F.asc("pos")]).drop("__v")


# Fuzzy scores, as percentages of common subsequences.


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    row = mask = (1 << len(a)) - 1
    for ch in b:
        hit = row & at.get(ch, 0)
        row = (row + hit | row - hit) & mask
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length in the longer one, ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    n = len(short)
    return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)) if long[max(0, i) : i + n])


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    if not x or not y:
        return 0.0
    if both and (x <= y or y <= x):
        return 100.0
    more = [" ".join([*([both] if both else []), *sorted(s)]) for s in (x - y, y - x)]
    return max(ratio(more[0], more[1]), *([ratio(both, m) for m in more] if both else [0.0]))


def best_score(a: str, b: str, partial_from: int = 6) -> float:
    scores = [ratio(a, b), token_sort_ratio(a, b), token_set_ratio(a, b)]
    return max(scores + ([partial_ratio(a, b)] if len(a) >= partial_from else []))


def score_pairs(pairs: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [round(best_score(x, y), 4) for x, y in zip(b["q"], b["v"])]
            b = b.assign(score=s)
            yield b[b["score"] >= least][["query", "value", "score"]]

    return pairs.mapInPandas(run, "query long, value string, score double")


#: A word or pair of letters is hot above so many texts, and above a part of all occurrences that leaves MOST_HOT of them at most.
HOT, MOST_HOT = 1000, 10_000
#: Letters from rare to frequent; others are rarer. Any order is right, this one makes keys small.
LETTERS = "zqjxkvbywgpfmucdlhrsnioate "


@lru_cache(1 << 12)
def pairs_needed(n: int, least: float) -> int:
    """How many of the n - 1 pairs of neighbours in a text stand intact in one of at least its length, or in a window of at most its
    length, that it has the ratio `least` with: a letter missing from the text breaks two pairs, one put in breaks one."""
    d, broken = 1 - least / 100 + 1e-9, 0
    for gap in range(int(d * 2 * n / (1 - d)) + 1 if d < 1 else 0):
        if gap <= d * (2 * n + gap):  # the other is longer by gap
            broken = max(broken, 3 * int((d * (2 * n + gap) - gap) / 2) + gap)
        if gap <= d * (2 * n - gap):  # shorter by gap
            broken = max(broken, 3 * int((d * (2 * n - gap) - gap) / 2) + 2 * gap)
    return max(1, n - 1 - broken)


@lru_cache(1 << 14)
def text_forms(text: str) -> list[tuple[int, str, set[str]]]:
    """The text as it is (0) and with its words sorted, repeated or not (1), with pairs of neighbouring letters."""
    words = text.split(" ")
    forms = {(0, text), (1, " ".join(sorted(words))), (1, " ".join(sorted(set(words))))}
    return [(tag, f, {f[i : i + 2] for i in range(len(f) - 1)}) for tag, f in sorted(forms) if len(f) > 1]


def need_of(form: str, grams: set[str], least: float) -> int:
    return max(1, pairs_needed(len(form), least) - (len(form) - 1 - len(grams)))


def plausible(a: str, b: str, least: float) -> bool:
    """Whether some form of both shares as many pairs as the shorter one needs."""
    for tag, f, gf in text_forms(a):
        for other, g, gg in text_forms(b):
            short, own = min((f, gf), (g, gg), key=lambda x: (len(x[0]), len(x[1])))
            if tag == other and len(gf & gg) >= need_of(short, own, least):
                return True
    return False


def gram_keys(text: str, hot: dict[str, int], least: float) -> Iterator[tuple[str, bool, int, int]]:
    """(key, whether the shorter text may be found by it, length, pairs) for the forms of a text. Of the pairs that the shorter
    text needs one is among its rarest; where that one is hot, the next takes part in the key if two are needed."""
    for tag, form, grams in text_forms(text):
        order, need = sorted(grams, key=lambda g: (hot.get(g, 0), g)), need_of(form, grams, least)
        size = len(form), len(order)
        first, second = len(order) - need + 1, len(order) - need + 2
        for i, g in enumerate(order):
            if g not in hot:
                yield f"{tag}{g}", i < first, *size
                continue
            yield f"{tag}{g}.", need < 2 and i < first, *size  # one shared pair is all that can be asked for
            for j in range(i + 1, len(order)):
                yield f"{tag}{g}{order[j]}", need >= 2 and i < first and j < second, *size


def hot_word_keys(text: str, hot: set[str], least: float) -> Iterator[tuple[str, str]]:
    """(kind, key) for pairs that share hot words alone, a key for each set S of them. By the ratio of the shared words with one text's
    words that text is S but for little (kind "most", met by "any"); by the ratio of both, what stands beside S shares
    letters, at least as many as each side's length says: keys of two of its rarest letters, of one or of none."""
    words = sorted(set(text.split(" ")))
    own = [w for w in words if w in hot]
    t = least / 100 - 1e-9
    for k in range(1, 1 << len(own)):
        shared = [w for i, w in enumerate(own) if k >> i & 1]
        rest = [w for w in words if w not in shared]
        size, name = len(" ".join(shared)), " ".join(shared)
        beside = " ".join(rest)
        yield "any", name
        if not rest or t * (2 * size + 1 + len(beside)) <= 2 * size:
            yield "most", name
        counts: dict[str, int] = {}
        letters = []
        for c in beside:
            counts[c] = counts.get(c, 0) + 1
            letters.append((LETTERS.find(c), c, counts[c]))
        letters.sort(key=lambda x: (-x[2], x[0], x[1]))
        r, w = len(beside), size + 1
        least_shared = math.ceil((t / 2 * r - (1 - t) * w) / (1 - t / 2) - 1e-9)
        if least_shared <= 0:
            yield "both", f"{name}|"
        spelt = [f"{c}{n}" for _, c, n in letters]
        if least_shared <= 1:
            for c in spelt:
                yield "both", f"{name}|{c}"
        for i, j in combinations(range(r - max(least_shared, 2) + 2), 2) if r > 1 else ():
            yield "both", f"{name}|{spelt[i]}{spelt[j]}"


def fuzzy_keys(texts: DataFrame, name: str, hot_grams: dict[str, int], hot_words: set[str], least: float) -> DataFrame:
    """(t, kind, key, first, n, own): keys of distinct texts, of pairs of letters (kind "gram") and of words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for t in b["t"]:
                rows += {(t, "gram", *k) for k in gram_keys(t, hot_grams, least)}
                rows += {(t, "word", w, True, 0, 0) for w in set(t.split(" ")) - hot_words}
                rows += {(t, *k, True, 0, 0) for k in hot_word_keys(t, hot_words, least)}
            yield pd.DataFrame(rows, columns=["t", "kind", "key", "first", "n", "own"])

    return checkpointed(texts.select(F.col(name).alias("t")).distinct().mapInPandas(run, "t string, kind string, key string, first boolean, n int, own int"))


def frequent(texts: DataFrame, parts: Column, hot: int) -> dict[str, int]:
    """Texts of each part that very many have; MOST_HOT parts at most."""
    counts = texts.select(F.explode(F.array_distinct(parts)).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return {r["x"]: r["n"] for r in counts.where(F.col("n") > max(hot, total // MOST_HOT)).collect()}


def fuzzy_candidates(terms: DataFrame, pool: DataFrame, least: float, hot: int) -> DataFrame:
    """(q, v, by_word) for distinct texts q of terms and v of pool that a scorer may put at `least`."""
    both = terms.select(F.col("q").alias("x")).union(pool.select(F.col("v").alias("x")))
    grams = F.when(F.length("x") > 1, F.transform(F.sequence(F.lit(1), F.length("x") - 1), lambda i: F.substring(F.col("x"), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    hot_grams, hot_words = frequent(both, grams, hot), set(frequent(both, F.split("x", " "), hot))
    a = fuzzy_keys(terms, "q", hot_grams, hot_words, least).toDF("q", "kind", "key", "first_q", "nq", "oq")
    b = fuzzy_keys(pool, "v", hot_grams, hot_words, least).toDF("v", "kind", "key", "first_v", "nv", "ov")
    # The shorter text looks the longer one up by its rarest pairs of letters.
    shorter = F.struct("nq", "oq") <= F.struct("nv", "ov")
    grams, words = F.col("kind") == "gram", F.col("kind").isin("word", "both")
    found = [a.where(words).join(b.where(words), ["kind", "key"]).select("q", "v", F.lit(True).alias("by_word"))]
    found.append(a.where(grams & F.col("first_q")).join(b.where(grams), ["kind", "key"]).where(shorter).select("q", "v", F.lit(False).alias("by_word")))
    found.append(a.where(grams).join(b.where(grams & F.col("first_v")), ["kind", "key"]).where(~shorter).select("q", "v", F.lit(False).alias("by_word")))
    for x, y in (("most", "any"), ("any", "most")):
        found.append(a.where(F.col("kind") == x).drop("kind").join(b.where(F.col("kind") == y).drop("kind"), "key").select("q", "v", F.lit(True).alias("by_word")))
    letters = lambda c: F.explode(F.array_distinct(F.split(c, "")))
    for one, other in ((terms, pool), (pool, terms)):  # a text of one letter
        (x,), (y,) = one.columns, other.columns
        found.append(other.withColumn("w", letters(y)).join(one.where(F.length(x) == 1).withColumn("w", F.col(x)), "w").select("q", "v", F.lit(True).alias("by_word")))
    return reduce(DataFrame.union, found).groupBy("q", "v").agg(F.max("by_word").alias("by_word"))


def fuzzy(terms: DataFrame, pool: DataFrame, least: float = 82.0, hot: int = HOT) -> DataFrame:
    """(query, value, score): pool values that any scorer puts at `least` or above for any term of a query.

    No such pair is missed. Pairs of neighbouring letters are ordered by rarity, and the shorter text looks the longer ones up by so many
    of its rarest that one must be shared. Texts that share a word meet by it; where the words that they share are hot, they meet by
    all of them and by what stands beside them (`hot_word_keys`). So a key that very many texts have is split, unless all of them match."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    t = terms.select("query", clean(F.col("term")).alias("q")).where("q <> ''").distinct()
    p = pool.select("value", clean(F.col("value")).alias("v")).where("v <> ''").distinct()
    pairs = checkpointed(fuzzy_candidates(t.select("q").distinct(), p.select("v").distinct(), least, hot))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = [round(best_score(x, y), 4) if word or plausible(x, y, least) else 0.0 for x, y, word in zip(b["q"], b["v"], b["by_word"])]
            b = b.assign(score=score)
            yield b[b["score"] >= least][["q", "v", "score"]]

    scored = pairs.mapInPandas(run, "q string, v string, score double")
    return scored.join(t, "q").join(p, "v").groupBy("query", "value").agg(F.max("score").alias("score"))


def exhaustive(terms: DataFrame, pool: DataFrame, least: float = 82.0) -> DataFrame:
    """All pairs, to hold `fuzzy` against on small vocabularies."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    pairs = terms.select("query", clean(F.col("term")).alias("q")).crossJoin(pool.select("value", clean(F.col("value")).alias("v")))
    return score_pairs(pairs, least).groupBy("query", "value").agg(F.max("score").alias("score"))
