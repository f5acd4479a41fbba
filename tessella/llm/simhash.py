"""SimHash near-dedup by multi-index hashing (operator 9).

A fingerprint has 64 bits, cut into two segments of 32. Two fingerprints that differ in at most two bits
differ in at most one bit in one of the segments, so each fingerprint looks up, per segment, the ball of
radius one round its own segment value in a table keyed by (segment, value); complete distances are
verified in the join. A pair that differs in a bit is found from the side that has 0 there, which halves
the lookups. Equal fingerprints are collapsed first, so copies never meet each other; a fingerprint
has at most 2,080 others within two bits, which bounds the links.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; a row without
doc_id takes the smallest id of its component, null if there is none; repeated ids are one node; an
empty table gives an empty result. Extra columns are ignored.

`keep_one`, the pipeline's stage, takes five-word shingles. Its tables link fingerprints at up to STAGE_REACH
bits, which the balls of radius one still reach; texts further apart that are near copies by the
similarity of their shingles are linked by `shingles`."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import connected_components, materialise

SEED, WORDS, REACH, STAGE_REACH = 42, 3, 2, 3


def fingerprint(text: bytes, words: int = WORDS) -> int:
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()  # bytes: only A-Z and ASCII white space
    if not tokens:
        return 0
    joined, size = b" ".join(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size).tolist(), ends.tolist()
    if len(tokens) < words:
        starts, ends = [0], [len(joined)]
    else:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    ones = np.zeros(64, np.int64)
    for a in range(0, len(starts), 16384):
        hashes = np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, map(slice, starts[a : a + 16384], ends[a : a + 16384])), repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for each row of docs."""

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b) for all pairs of different fingerprints at `reach` bits or fewer (three at most: then one segment
    differs in one bit or none), from (fp, rep), one row each."""
    if reach > 3:
        raise ValueError("two segments with balls of radius one reach three bits")
    segments = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.shiftrightunsigned("fp", 32).alias("value")), F.struct(F.lit(1).alias("part"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("value"))))
    rows = fps.select("fp", "rep", segments.alias("s")).select("fp", "rep", "s.part", "s.value")
    ball = F.expr("filter(transform(sequence(0, 32), i -> if(i = 32, value, value | shiftleft(1L, i))), (x, i) -> i = 32 or x <> value)")
    probes = rows.select(F.col("fp").alias("fp1"), F.col("rep").alias("rep1"), "part", F.col("value").alias("own"), F.explode(ball).alias("value"))
    near = F.expr("bit_count(fp1 ^ fp)") <= reach
    found = probes.join(rows, ["part", "value"]).where(near & ((F.col("own") != F.col("value")) | (F.col("fp1") < F.col("fp"))))
    return found.select(F.col("rep1").alias("a"), F.col("rep").alias("b"))


def near_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs, by op9's contract."""
    fps = materialise(fingerprints(docs), "fingerprints")
    # The smallest id that has a fingerprint stands for it.
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "representatives")
    # An id that stands under several fingerprints (repeated rows) joins their classes.
    several = fps.groupBy("doc_id").agg((F.min("fp") != F.max("fp")).alias("several")).where("several and doc_id is not null")
    several = fps.join(several.select("doc_id"), "doc_id", "left_semi").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    parts = connected_components(links(reps).union(several))
    named = materialise(reps.join(parts, F.col("rep") == F.col("id"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "components")
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = shingles.WORDS, least: float = shingles.LEAST) -> DataFrame:
    """(doc_id, same, component_id) for each row of docs, by fingerprints and the similarity of their shingles."""
    return shingles.near_copies(docs, lambda fps: links(fps, STAGE_REACH), words, least)


def keep_one(docs: DataFrame, words: int = shingles.WORDS, least: float = shingles.LEAST) -> DataFrame:
    """One row per component, the one that gives it its id: the columns of docs. Rows without doc_id pass
    through, as nothing can tell them apart later."""
    found = near_duplicates(docs, words, least).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").select(docs.columns)
    several = materialise(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    if not several.isEmpty():  # of the rows under one id, the one with the smallest hash, so that reruns agree
        own = [F.col(f"`{c}`") for c in docs.columns]
        one = kept.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*own), F.xxhash64(F.to_json(F.struct(*own)))).alias("row"))
        kept = kept.join(several, "doc_id", "left_anti").select(*own).unionByName(one.select("row.*"))
    return kept.unionByName(docs.where("doc_id is null"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_fingerprints(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
