"""Best-fit packing of tokenised documents into sequences (operator 6).

Tokens are counted on the executors; only a histogram of piece lengths (at most 4,096 rows, whatever the
input) reaches the driver, where the packing is planned for classes of equal bins:

1. Linear grouping: lengths above a part of the capacity (LARGE), in descending order, form GROUPS groups of equal cardinality
   and are rounded up to the longest of their group.
2. Configurations of these few sizes are optimised by linear programming with column generation (the
   knapsack over one sequence gives the next configuration); whole parts are kept.
3. Actual lengths take the places of the rounded ones, which leaves their true gaps.
4. What is left over and all small lengths go, longest first, where they fit best.

The plan says which ranks of which length go where; ranks come from counts by (length, bucket), where a
frequent length is dealt to many buckets by row, so that pieces of one length don't meet in one task.

Edge cases: null and empty texts are one token (the end); null ids are kept as they are; repeated rows are packed each; an
empty table gives no rows; a text that spells a special token is encoded as the tokenizer does it."""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections import defaultdict, deque
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, materialise, ragged, slices, split_words, text_bytes

CAPACITY, END, GROUPS, PIVOTS = 4096, 1, 64, 250
#: A length is large above such a part of the capacity; each is tried, the shorter plan is kept.
LARGE = (3, 2)
#: Ranks of one length are counted in buckets of about so many rows.
BUCKET_ROWS = 100
#: Ranks of one length that meet their slots together.
CHUNK_ROWS = 8192
#: Chunks whose ids a Python worker remembers; beyond that it keeps those that it has met in several parts.
REMEMBERED = 300_000
#: Bytes of text that a task gets, and works on, at a time.
PART_BYTES = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Kinds of bytes for cutting: ASCII lower-case letters, ASCII punctuation without the apostrophe, and
#: the rest, next to which nothing is cut. Cuts between letters and punctuation are pre-token boundaries.
KINDS = np.full(256, 3, np.uint8)
KINDS[[0x20, 9, 10, 11, 12, 13]] = 0
KINDS[97:123] = 1
KINDS[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2


class Encoder:
    """ids of many texts by way of their distinct chunks, each encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()  # those of known that were met again
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def learn(self, chunks: pa.Array) -> None:
        """Encodes chunks. Those that are one pre-token (letters only, or punctuation only) go in joined
        texts, cut again after the ids that end a word."""
        plain = pc.or_(pc.utf8_is_alpha(chunks), pc.match_substring_regex(chunks, r"^[!-&(-/:-@\[-`{-~]+$"))
        single, rest = pc.filter(chunks, plain).to_pylist(), pc.filter(chunks, pc.invert(plain)).to_pylist()
        for a in range(0, len(single), 2000):
            part = single[a : a + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                raw, stops = ids.tobytes(), (ends * 4).tolist()
                self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops))))
            else:
                rest += part
        for a in range(0, len(rest), 2000):
            part = rest[a : a + 2000]
            for s, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[s] = np.array(e.ids, np.uint32).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and where each text ends in them."""
        data, off = text_bytes(texts)
        upper = (data >= 65) & (data <= 90)
        upper[:-1] &= data[1:] < 128  # a following mark may combine with one case only
        chunks, counts = split_words(np.where(upper, data + 32, data).astype(np.uint8), off, KINDS)
        coded = chunks.dictionary_encode()
        words = coded.dictionary.cast(pa.large_string())
        names = words.to_pylist()
        if len(self.known) > REMEMBERED:
            kept = self.again if len(self.again) <= REMEMBERED // 2 else ()
            self.known, self.again = {w: self.known[w] for w in kept}, set()
        self.again.update(filter(self.known.__contains__, names))
        fresh = [w for w in names if w not in self.known]
        if fresh:
            self.learn(pa.array(fresh, pa.large_string()))
        raws = list(map(self.known.__getitem__, names))
        flat = np.frombuffer(b"".join(raws), np.uint32)
        size = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        first = np.cumsum(size) - size
        codes = coded.indices.to_numpy()
        n = size[codes]
        ids = flat[np.repeat(first[codes], n) + ragged(n)]
        return ids, np.append(0, np.cumsum(n))[np.cumsum(counts)]


_encoders: dict[str, Encoder] = {}


def shared(path: str) -> Encoder:
    """The encoder of this Python worker: one for each task would leave its memory behind."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document, see PIECES."""

    def run(batches):
        encoder = shared(path)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                texts = part.column("text")
                special = pc.fill_null(pc.match_substring(texts, "<|"), False)
                ids, ends = encoder.encode(pc.if_else(special, "", texts))
                out = []
                for doc, text, odd, a, b in zip(part.column("doc_id").to_pylist(), texts, special.to_pylist(), np.append(0, ends[:-1]).tolist(), ends.tolist()):
                    own = np.array(encoder.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, np.uint32) if odd else ids[a:b]
                    own = np.append(own, np.uint32(END)).astype("<u4")
                    out += [(doc, k, s, len(p := own[s : s + capacity]), crc32(p.tobytes())) for k, s in enumerate(range(0, len(own), capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], [f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes (ascending) within the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(int(sizes[0]), capacity + 1):
        v = best[c - sizes[: fits[c]]] + worth[: fits[c]]
        k = int(v.argmax())
        if v[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = v[k], k
        else:
            best[c] = best[c - 1]
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            column[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(how often, how many of each size): the whole parts of a good fractional packing."""
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(PIVOTS):
        value, column = knapsack(sizes, np.linalg.solve(basis.T, np.ones(len(sizes))), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        r = int(ratio.argmin())
        x = np.maximum(x - ratio[r] * step, 0)
        x[r], basis[:, r] = ratio[r], column
    left, found = demand.astype(np.int64), []
    for k in np.argsort(-x):
        column = basis[:, k].astype(np.int64)
        n = int(min([np.floor(x[k] + 1e-6), *(left[column > 0] // column[column > 0])]))
        if n > 0:
            found.append((n, column))
            left = left - n * column
    return found


def take(queue: deque, n: int) -> list[tuple[int, int]]:
    got = []
    while n:
        length, have = queue.popleft()
        m = min(n, have)
        got.append((length, m))
        if have > m:
            queue.appendleft((length, have - m))
        n -= m
    return got


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """(how many sequences, the lengths in each of them): the shorter of the plans by LARGE."""
    return min((plan_with(histogram, capacity, capacity // part, groups) for part in LARGE), key=lambda bins: sum(n for n, _ in bins))


def plan_with(histogram: dict[int, int], capacity: int, small: int, groups: int) -> list[tuple[int, list[int]]]:
    bins = [(histogram[capacity], [capacity])] if histogram.get(capacity) else []
    large = sorted(((k, n) for k, n in histogram.items() if small < k < capacity), reverse=True)
    rest = defaultdict(int, {k: n for k, n in histogram.items() if k <= small})
    total = sum(n for _, n in large)
    if total:
        queue, grouped = deque(large), []
        for g in range(groups):
            if n := (total * (g + 1)) // groups - (total * g) // groups:
                grouped.append(take(queue, n))
        grouped.reverse()  # ascending by size
        by_size: dict[int, deque] = {}
        for g in grouped:
            by_size.setdefault(g[0][0], deque()).extend(g)
        sizes = np.array(sorted(by_size))
        demand = np.array([sum(n for _, n in by_size[s]) for s in sizes])
        for s in sizes:
            by_size[s] = deque(sorted(by_size[s], reverse=True))
        for n, column in configurations(sizes, demand, capacity):
            places = [deque(take(by_size[s], n)) for s, many in zip(sizes, column) for _ in range(many)]
            while n:
                m = min(p[0][1] for p in places)
                bins.append((m, [take(p, m)[0][0] for p in places]))
                n -= m
        for q in by_size.values():
            for k, n in q:
                rest[k] += n
    gaps: dict[int, list] = defaultdict(list)
    for n, lengths in bins:
        gaps[capacity - sum(lengths)].append((n, lengths))
    order = sorted(gaps)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                have, lengths = gaps[gap].pop()
                m = min(n, have)
                if have > m:
                    gaps[gap].append((have - m, lengths))
                if not gaps[gap]:
                    del gaps[gap], order[at]
                new = [(m, [*lengths, length])]
            else:
                each = min(capacity // length, n)
                m = n // each * each
                new = [(n // each, [length] * each)]
            n -= m
            for many, lengths in new:
                gap = capacity - sum(lengths)
                if gap not in gaps:
                    insort(order, gap)
                gaps[gap].append((many, lengths))
    return [b for of_gap in gaps.values() for b in of_gap]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    spark = docs.sparkSession
    with arrow_batches(spark, PART_BYTES):
        rows = materialise(pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")  # numbers that stay
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, ranks, base = [], defaultdict(int), 0
    for n, lengths in plan(histogram, capacity):
        offset = 0
        for k in lengths:
            slots.append((k, ranks[k], ranks[k] + n, base, offset))
            ranks[k] += n
            offset += k
        base += n
    # A row for each length, `capacity` at most, which can be broadcast; slots grow with the plan, so Spark picks by their size.
    lengths = spark.createDataFrame([(k, -(-n // BUCKET_ROWS)) for k, n in histogram.items()], "length long, buckets int")
    slots = spark.createDataFrame(slots, "length long, low long, high long, base long, offset long")
    slots = slots.withColumn("chunk", F.explode(F.expr(f"sequence(low div {CHUNK_ROWS}, (high - 1) div {CHUNK_ROWS})")))
    rows = rows.join(F.broadcast(lengths), "length").withColumn("bucket", F.expr("pmod(xxhash64(row), buckets)"))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(counts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.withColumn("chunk", F.expr(f"rank div {CHUNK_ROWS}")).join(slots, ["length", "chunk"]).where("low <= rank and rank < high")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tokenizer_path()))
