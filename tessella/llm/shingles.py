"""Near copies by the similarity of their word shingles, beyond what fingerprints reach (the pipeline's
near-duplicate stage, on top of the multi-index hashing of `simhash`).

Two texts are near copies where the Jaccard similarity of their sets of WORDS consecutive words is LEAST or
more. Fingerprints at a few bits find the closest of them; a radius of about 17 of 64 bits, at which their tables
separate nothing, would be needed down to LEAST. So texts also meet by bands of MinHash values: with BANDS bands
of ROWS values a pair at similarity s has no common band with probability (1 - s**ROWS)**BANDS, three in a million
at 0.8 and less above. Every pair that is compared is compared on the complete sets, those of near fingerprints
too: each text of a component of fingerprints is compared with the component's first, and if it is not
similar to that one it meets the others by its bands.

Groups of up to SMALL texts compare each with each. A larger one is never expanded into pairs: in each of ROUNDS
rounds its members are compared with a centre, the one that meets most others over all bands, and those found
similar leave with it; what is left of SMALL or fewer compares each with each. Where a large group is not of one
component then, its members meet anew by pairs of their bands, of which half-similar texts share few; those groups are
compared in the same way. What still isn't of one component in a large group then is compared exactly: by an inverted index
of rare shingles, with the length, prefix and positional filters of set similarity joins, which lose no pair. Pairs that
share a rare shingle can be quadratic in number where many texts are just below LEAST; they are shuffled, never gathered.

Edge cases: texts without words are equal, and texts of fewer than WORDS words are one shingle; a row without
doc_id takes the smallest id of its component, null if there is none; repeated ids are one node; an empty table
gives an empty result. Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, connected_components, materialise, slices, split_words, text_bytes

SEED, WORDS, LEAST = 42, 5, 0.8
BANDS, ROWS, ROUNDS, SMALL, CHUNK = 24, 4, 3, 12, 1024
#: Bytes of text that a task works on at a time.
PART_BYTES = 2 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of 64-bit hashes: a bit is 1 where over half of them have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles, sorted and distinct."""
    from xxhash import xxh64_intdigest

    data, off = text_bytes(texts)
    tokens, counts = split_words(LOWER[data], off)
    coded = tokens.dictionary_encode()
    known = np.fromiter((xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h, factors = known[coded.indices.to_numpy()], odd_numbers(words, SEED)
    rolled = np.zeros(len(h), np.uint64)
    for j in range(words):
        rolled[: len(h) - j] += h[j:] * factors[j]
    end = 0
    for n in counts.tolist():
        begin, end = end, end + n
        runs = rolled[begin : end - words + 1] if n >= words else (h[begin:end] * factors[:n]).sum(keepdims=True)[: min(n, 1)]
        yield np.unique(mixed(runs))


def band_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number per band, from BANDS * ROWS MinHash values."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(low, (hashes[at : at + CHUNK, None] * a + b).min(0), out=low)
    low = mixed(low).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mixed(key * MIX + low[:, j])
    return key


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, same, size, fp, keys) for each row of docs: a hash of its set, how many shingles it has, its fingerprint, the keys of
    its bands."""

    def run(batches):
        from xxhash import xxh64_intdigest

        a, b = odd_numbers(BANDS * ROWS, 1), odd_numbers(BANDS * ROWS, 2)
        for whole in batches:
            for part in slices(whole, "text", PART_BYTES):
                same, size, fps, keys = [], [], [], []
                for s in shingle_sets(part.column("text"), words):
                    same.append(xxh64_intdigest(s.tobytes()))
                    size.append(len(s))
                    fps.append(majority(s))
                    keys.append(band_keys(s, a, b).view(np.int64))
                numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (same, fps)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *numbers, pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same", "fp", "size", "keys"])

    return texts_of(docs).mapInArrow(run, "doc_id long, same long, fp long, size long, keys array<long>")


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(same, hashes binary) for each row of docs."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for whole in batches:
            for part in slices(whole, "text", PART_BYTES):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([xxh64_intdigest(s) for s in sets], np.uint64).view(np.int64)), pa.array(sets, pa.binary())], ["same", "hashes"])

    return texts_of(docs).mapInArrow(run, "same long, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose sets are similar by `least` or more."""

    def run(batches):
        for b in batches:
            x, y = ([np.frombuffer(v.as_py(), np.uint64) for v in b.column(n)] for n in ("x", "y"))
            keep = []
            for s, t in zip(x, y):
                both = len(np.intersect1d(s, t, assume_unique=True)) if min(len(s), len(t)) >= least * max(len(s), len(t)) - 1e-9 else 0
                keep.append(both >= least * (len(s) + len(t) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def alike(a: str, b: str, least: float) -> Column:
    """Whether two sizes allow a similarity of `least`."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def each_with_each(members: DataFrame, least: float) -> DataFrame:
    """(a, b) of sizes alike within groups that have SMALL members at most."""
    groups = members.groupBy("key").agg(F.collect_list(F.struct("same", "c", "size")).alias("all"))
    both = groups.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x.same < y.same and x.c <> y.c")
    return both.where(alike("x.size", "y.size", least)).select(F.col("x.same").alias("a"), F.col("y.same").alias("b"))


def with_centre(members: DataFrame) -> DataFrame:
    """members with the pair (a, b) of each and its group's centre, and the centre's size (of); without those in the centre's component."""
    centres = members.groupBy("key").agg(F.max(F.struct("degree", "same", "c", "size")).alias("m"))
    met = members.join(centres, "key").where("c <> m.c")
    return met.withColumns({"a": F.least("same", "m.same"), "b": F.greatest("same", "m.same"), "of": F.col("m.size")}).drop("m")


def compared(members: DataFrame, sets: DataFrame, least: float) -> tuple[list[DataFrame], bool]:
    """Tables of similar pairs (a, b) from groups of members (key, same, c, size, degree, n), n being the group's members; and whether
    there are large groups."""
    found = []
    large = members.where(F.col("n") > SMALL)
    pairs = each_with_each(members.where(F.col("n") <= SMALL), least)
    some = not large.isEmpty()
    if some:
        pairs = pairs.union(with_centre(large).where(alike("size", "of", least)).select("a", "b"))
    for turn in range(ROUNDS + 1):
        found.append(materialise(verified(materialise(pairs.distinct(), "pairs"), sets, least), "near"))
        if not some or turn == ROUNDS:
            break
        large = materialise(with_centre(large).join(found[-1], ["a", "b"], "left_anti").select("key", "same", "c", "size", "degree"), "left")
        if turn < ROUNDS - 1:
            pairs = with_centre(large).where(alike("size", "of", least)).select("a", "b")
        else:
            few = large.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= SMALL).select("key")
            pairs = each_with_each(large.join(few, "key"), least)
    return found, some


def finer(members: DataFrame) -> DataFrame:
    """The members by pairs of their groups."""
    own = members.groupBy("same", "c", "size", "degree").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # BANDS keys at most
    two = own.select("same", "c", "size", "degree", F.posexplode("keys").alias("i", "x"), "keys")
    two = two.select("same", "c", "size", "degree", "x", F.explode(F.expr("slice(keys, i + 2, size(keys))")).alias("y"))
    two = two.select(F.xxhash64("x", "y").alias("key"), "same", "c", "size", "degree")
    sizes = materialise(two.groupBy("key").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("apart")).where("apart").drop("apart"), "crowded")
    return materialise(two.join(sizes, "key"), "members")


def shingles_of(sets: DataFrame) -> DataFrame:
    """(same, h): a row for each shingle."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                same, own = b.column("same")[at : at + 64], [np.frombuffer(v.as_py(), np.int64) for v in b.column("hashes")[at : at + 64]]
                yield pa.RecordBatch.from_arrays([same.take(pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))), pa.array(np.concatenate(own))], ["same", "h"])

    return sets.select("same", "hashes").mapInArrow(run, "same long, h long")


def by_rare_shingles(texts: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of texts (same, c, size) of unlike c: all that may be similar by `least`. With the rarest shingles first, two such texts
    share one among the first size - least * size + 1 of both, and behind the first they share no more than either has left."""
    rows = materialise(shingles_of(sets.join(texts.select("same"), "same", "left_semi")), "shingles")
    counts = rows.groupBy("h").agg(F.count("*").alias("n"))
    placed = rows.join(counts, "h").withColumn("at", F.row_number().over(Window.partitionBy("same").orderBy("n", "h")) - 1)
    first = placed.join(texts, "same").where(F.col("at") <= F.col("size") - F.ceil(least * F.col("size") - 1e-9))
    first = materialise(first.where("n > 1").select("h", "same", "c", "size", (F.col("size") - F.col("at")).alias("left")), "prefixes")
    x, y = (first.select("h", *[F.col(c).alias(f"{c}_{i}") for c in ("same", "c", "size", "left")]) for i in "xy")
    may = (F.col("same_x") < F.col("same_y")) & (F.col("c_x") != F.col("c_y")) & alike("size_x", "size_y", least)
    met = x.join(y, "h").where(may & (F.least("left_x", "left_y") >= least / (1 + least) * (F.col("size_x") + F.col("size_y")) - 1e-9))
    return met.select(F.col("same_x").alias("a"), F.col("same_y").alias("b")).distinct()


def apart(members: DataFrame, found: list[DataFrame]) -> DataFrame:
    """The members (key, same, c, size, degree) of groups that aren't of one component by the pairs found, c being that."""
    parts = materialise(connected_components(reduce(DataFrame.union, [e.select("a", "b") for e in found])), "parts")
    named = members.join(parts.toDF("id", "component"), F.col("same") == F.col("id"), "left")
    named = materialise(named.select("key", "same", F.coalesce("component", "c").alias("c"), "size", "degree"), "named")
    several = named.groupBy("key").agg((F.min("c") != F.max("c")).alias("several")).where("several").select("key")
    return named.join(several, "key", "left_semi")


def near_copies(docs: DataFrame, close, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(doc_id, same, component_id) for each row of docs. close: gives the pairs (a, b) of near fingerprints
    from (fp, rep)."""
    rows = materialise(signatures(docs, words), "signatures")
    nodes = materialise(rows.groupBy("same").agg(F.min("doc_id").alias("rep"), F.any_value("fp").alias("fp"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys")).where("rep is not null"), "nodes")

    def sets_for(wanted: DataFrame) -> DataFrame:
        some = docs.join(nodes.join(wanted, "same", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return materialise(sets_of(some, words).join(wanted, "same", "left_semi").dropDuplicates(["same"]), "sets")

    # An id that stands under several sets (repeated rows) joins their classes.
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("same").alias("a"), F.max("same").alias("z")).where("a <> z")
    found = [rows.join(ids, "doc_id").select("a", F.col("same").alias("b")).distinct()]
    # Fingerprints: equal ones, near ones by their tables; each node with the first of its component.
    prints = materialise(nodes.groupBy("fp").agg(F.min("same").alias("rep")), "fingerprints")
    equal = nodes.join(prints.toDF("fp", "first"), "fp").where("same <> first").select(F.col("first").alias("a"), F.col("same").alias("b"))
    first = connected_components(equal.union(close(prints))).where("id <> component").toDF("b", "a")
    size = nodes.select("same", "size")
    first = first.join(size.toDF("b", "size"), "b").join(size.toDF("a", "of"), "a").where(alike("size", "of", least)).select("a", "b")
    first = materialise(first, "first")
    stars = materialise(verified(first, sets_for(first.select(F.explode(F.array("a", "b")).alias("same")).distinct()), least), "stars")
    found.append(stars)
    # Bands: texts that one star holds need not meet again.
    parts = stars.select(F.col("b").alias("same"), F.col("a").alias("c"))
    members = nodes.join(parts, "same", "left").select("same", F.coalesce("c", "same").alias("c"), "size", F.explode("keys").alias("key"))
    crowded = members.groupBy("key").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("apart")).where("apart").select("key", "n")
    members = materialise(members.join(materialise(crowded, "crowded"), "key"), "members")
    degrees = members.groupBy("same").agg(F.sum("n").alias("degree"))
    members = materialise(members.join(degrees, "same").select("key", "same", "c", "size", "n", "degree"), "ranked")
    sets = sets_for(members.select("same").distinct())
    near, some = compared(members, sets, least)
    found += near
    if some:
        large = members.where(F.col("n") > SMALL)
        found += compared(finer(apart(large, found)), sets, least)[0]
        rest = materialise(apart(large, found).select("same", "c", "size").distinct(), "rest")
        if not rest.isEmpty():
            found.append(materialise(verified(materialise(by_rare_shingles(rest, sets, least), "pairs"), sets, least), "near"))
    parts = materialise(connected_components(reduce(DataFrame.union, [e.select("a", "b") for e in found])), "parts")
    named = nodes.join(parts, F.col("same") == F.col("id"), "left").select("same", "rep", F.coalesce("component", "same").alias("c"))
    least_id = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = materialise(named.join(least_id, "c").select("same", "component_id"), "components")
    return rows.join(named, "same", "left").select("doc_id", "same", "component_id")
