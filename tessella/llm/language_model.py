"""Language-model scores by context-tree weighting over bytes (operator 7).

A text is its bytes (A-Z lower-cased) and an end symbol, a byte that UTF-8 never has; before it stand end
symbols too. A byte is decomposed into eight binary decisions; each decision has a context tree over the DEPTH
bytes before it, across the ends of words. Every node has a Krichevsky-Trofimov estimate from the training
texts; the weighted probability of a node is half its own plus half the product of its children's, and a
prediction mixes the estimates of all depths with the posterior weights that follow. A node that training
never reached is no part of the tree: there the depths above share its weight.

How the work is dealt out:

* Documents are gathered into units of about UNIT_BYTES of text, where they lie; a unit counts its distinct
  (context, byte) keys and its distinct words once each.
* Counts climb a tree of merges, at most about FAN units or merged rows at a step. At each step a group is dealt to smaller
  homes: by one more byte of the context (keys) or six more bits of a hash (words). So a step never meets more than FAN
  shares of one home, and homes grow in number with the corpus, whatever keys are frequent.
* At the top a home holds whole subtrees below its bytes of context. The levels above are sums by
  (context, decision), made with DataFrame aggregations, level by level.
* Probabilities go down the same tree; a step answers only what its children asked. A unit's answers meet
  its text at last, the one time that texts are shuffled (compressed).

Edge cases: null and empty texts have the end token only; a null doc_id counts as training; repeated rows
are scored each; a text longer than a unit is a unit of its own, worked on in slices; an empty table gives an
empty result; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialise, ragged, slices, split_words, text_bytes

DEPTH, FOLDS, HELD, END = 5, 7, 2, 0xFF
UNIT_BYTES, SLICE_BYTES, FAN, ROOT_KEYS = 16 << 20, 2 << 20, 64, 200_000
#: Odd multipliers for the bytes of a word, place by place.
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
#: What rows hold: the text of a unit, counts of its keys, counts of its words.
TEXT, KEYS, WORDS = 0, 1, 2
SHARES = "kind int, home long, node long, items binary, counts binary, n long, v long"
UNITS = SHARES + ", ids array<long>, held array<boolean>, sizes array<long>"
ANSWERS = "kind int, home long, node long, items binary, counts binary"
NODES = "ctx long, decision long, zeros double, ones double, log_w double, share double"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def freed() -> None:
    """Gives back what Arrow's pool keeps of the unit before."""
    pa.default_memory_pool().release_unused()


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


# Blobs: numbers byte plane by byte plane, so that the usual compression of shuffles finds their zeros.


def pack_numbers(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack(kind: int, items: pa.Array) -> bytes:
    if kind == WORDS:
        return b" ".join(items.to_pylist())
    k = items.to_numpy()
    return pack_numbers(np.diff(k, prepend=np.uint64(0)))  # ascending within a blob


def unpack(kind: int, blobs: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The items of blobs one after another, and how many each has."""
    if kind == WORDS:
        return split_words(np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)]))
    parts = [np.cumsum(unpack_numbers(b), dtype=np.uint64) for b in blobs]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array([len(p) for p in parts], np.int64)


# Homes: a key's are the last bytes of its context, a word's the low bits of its hash. Each level refines the last.


def home_bits(kind: int, level: int) -> int:
    return 8 * tail_bytes(level) if kind == KEYS else min(6 * level, 30)


def tail_bytes(level: int) -> int:
    return min(level + 1, DEPTH)


def homes(kind: int, items: pa.Array, level: int) -> np.ndarray:
    mask = (1 << home_bits(kind, level)) - 1
    if kind == KEYS:
        return ((items.to_numpy() >> np.uint64(8)) & np.uint64(mask)).astype(np.int64)
    off = np.frombuffer(items.buffers()[1], np.int64)[items.offset : items.offset + len(items) + 1]
    data, at = np.frombuffer(items.buffers()[2] or b"", np.uint8)[off[0] : off[-1]], ragged(np.diff(off))
    h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * POWERS[at % len(POWERS)] * (at // len(POWERS) + 1).astype(np.uint64), off[:-1] - off[0]) if len(data) else np.zeros(0, np.uint64)
    return ((h ^ (h >> np.uint64(29))) * POWERS[1] >> np.uint64(34)).astype(np.int64) & mask


def order_of(kind: int, items: pa.Array, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of items by home (and by key), and the homes in that order."""
    home = homes(kind, items, level)
    order = np.lexsort((items.to_numpy(), home)) if kind == KEYS else np.argsort(home, kind="stable")
    return order, home[order]


def dealt(kind: int, items: pa.Array, counts: np.ndarray, level: int, node: int) -> Iterator[tuple]:
    """A row of SHARES for each home."""
    order, home = order_of(kind, items, level)
    items, counts = items.take(pa.array(order)), counts[order]
    cuts = np.append(np.flatnonzero(np.diff(home, prepend=-1)), len(home)).tolist()
    for a, b in zip(cuts, cuts[1:]):
        own = counts[a:b]
        yield kind, int(home[a]), node, pack(kind, items.slice(a, b - a)), pack_numbers(own), int(own.sum()), int((own > 0).sum())


class Tally:
    """Distinct items with their counts, gathered part by part."""

    def __init__(self):
        self.items, self.counts = [], []

    def add(self, items: pa.Array, counts: np.ndarray) -> None:
        self.items.append(items)
        self.counts.append(counts)

    def total(self) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
        """Items, their sums, and for each part the places of its items."""
        at, items = coded(pa.concat_arrays(self.items))
        sums = np.bincount(at, weights=np.concatenate(self.counts), minlength=len(items)).astype(np.int64)
        return items, sums, np.split(at, np.cumsum([len(i) for i in self.items])[:-1])


# Units.


def keys_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """context << 8 | byte of every byte and end of the texts; the byte before is the context's lowest."""
    room = np.full(int(off[-1]) + (DEPTH + 1) * (len(off) - 1), END, np.uint8)
    scored = np.ones(len(room), bool)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        p = a + i * (DEPTH + 1)
        room[p + DEPTH : p + DEPTH + b - a] = data[a:b]
        scored[p : p + DEPTH] = False
    keys = np.zeros(len(room) - DEPTH, np.uint64)
    for j in range(DEPTH + 1):
        keys |= room[DEPTH - j : len(room) - j].astype(np.uint64) << np.uint64(8 * j)
    return keys[scored[DEPTH:]]


def parts_of(data: np.ndarray, off: np.ndarray):
    """The documents of a unit slice by slice: numbers, keys and how many each has, words and how many each has."""
    first = 0
    while first < len(off) - 1:
        last = max(first + 1, int(np.searchsorted(off, off[first] + SLICE_BYTES, "right")) - 1)
        own, cuts = data[off[first] : off[last]], off[first : last + 1] - off[first]
        yield first, last, keys_of(own, cuts), np.diff(cuts) + 1, *split_words(own, cuts)
        first = last


def coded(items: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = items.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def describe(batches):
    """The rows of all units of a task (UNITS): texts, and training counts by home. Items that only
    held-out texts have come with count 0."""
    serial, pending, size = TaskContext.get().partitionId() << 32, [], 0

    def unit(parts):
        whole = pa.Table.from_batches(parts).combine_chunks()
        data, off = text_bytes(whole.column("text").combine_chunks())
        data, held = LOWER[data], whole.column("held_out").to_numpy(zero_copy_only=False)
        tallies = {KEYS: Tally(), WORDS: Tally()}
        for first, last, keys, n_keys, words, n_words in parts_of(data, off):
            learned = np.repeat(~held[first:last], n_keys)
            for own, count in ((keys[learned], 1), (keys[~learned], 0)):
                own, n = np.unique(own, return_counts=True)
                tallies[KEYS].add(pa.array(own), n * count)
            codes, distinct = coded(words)
            tallies[WORDS].add(distinct, np.bincount(codes[np.repeat(~held[first:last], n_words)], minlength=len(distinct)))
        rows = [row for kind, tally in tallies.items() for row in dealt(kind, *tally.total()[:2], 1, serial)]
        columns = list(zip(*rows))
        more = [pa.nulls(len(rows), t) for t in (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, share_types())), *more], names(UNITS))
        text = pa.compress(data.tobytes(), "zstd", asbytes=True)
        row = [TEXT, 0, serial, text, None, len(data), len(off) - 1, whole.column("doc_id").to_pylist(), held.tolist(), np.diff(off).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [*share_types(), *(m.type for m in more)])], names(UNITS))

    for batch in batches:
        for part in slices(batch, "text", UNIT_BYTES):
            own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if pending and size + own > UNIT_BYTES:
                yield from unit(pending)
                serial, pending, size = serial + 1, [], 0
                freed()
            pending.append(part)
            size += own
    if pending:
        yield from unit(pending)


def share_types():
    return pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()


# Up and down the tree of merges.


def merge(level: int):
    """Sums of a group (kind, home, up), dealt to the homes of this level."""

    def run(key, table):
        kind, _, up = (k.as_py() for k in key)
        tally = Tally()
        tally.add(unpack(kind, table.column("items").to_pylist())[0], np.concatenate([unpack_numbers(b) for b in table.column("counts").to_pylist()]))
        items, counts, _ = tally.total()
        rows = dealt(kind, items, counts, level, up)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), share_types())], names(SHARES))

    return run


def answer(key, asked, known):
    """For each row that asks, the values of its items, from those of the homes that its group was dealt to."""
    kind = key[0].as_py()
    items, sizes = unpack(kind, asked.column("items").to_pylist())
    value_set, _ = unpack(kind, known.column("items").to_pylist())
    values = np.frombuffer(b"".join(known.column("counts").to_pylist()), np.float32 if kind == KEYS else np.int64)
    found = values[pc.index_in(items, value_set=value_set).to_numpy()]
    blobs = [x.tobytes() for x in np.split(found, np.cumsum(sizes)[:-1])] if len(sizes) else []
    return pa.Table.from_arrays([asked.column("kind"), asked.column("home"), asked.column("node"), asked.column("items"), pa.array(blobs, pa.binary())], names(ANSWERS))


def by_home(rows: DataFrame, level: int):
    """Rows by kind, home at that level, and node of the step above."""
    home = F.when(F.col("kind") == KEYS, F.col("home").bitwiseAND(F.lit((1 << home_bits(KEYS, level)) - 1))).otherwise(F.col("home").bitwiseAND(F.lit((1 << home_bits(WORDS, level)) - 1)))
    return rows.groupBy("kind", home.alias("at"), "up")


# The trees.


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after shifting small arguments up."""
    low = x < 8
    y, less = np.where(low, x + 8, x), np.zeros_like(x)
    for k in range(8):
        less += np.where(low, np.log(x + k), 0)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - less


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 8) arrays: the decision (bits before it, with a leading 1) and the bit taken."""
    j = np.arange(8)
    return (1 << j) | (byte[:, None] >> (8 - j)), (byte[:, None] >> (7 - j)) & 1


def mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of half own plus half below, and own's share of it."""
    w = np.logaddexp(own, below) - np.log(2.0)
    return w, np.exp(own - np.log(2.0) - w)


def subtrees(keys: np.ndarray, n: np.ndarray, top: int):
    """Nodes of depths DEPTH..top for keys that come with all of their home. Of depth top: (context << 8 |
    decision, zeros, ones, log weighted); for each (row, bit) its node there, and the probability of the bit given by top and below."""
    byte = (keys & np.uint64(255)).astype(np.int64)
    decision, bit = decisions(byte)
    context = (keys >> np.uint64(8)) << np.uint64(8)  # below, nodes are context << 8 | decision
    mask = lambda depth: np.uint64(((1 << (8 * depth)) - 1) << 8)
    node, at = np.unique(((context & mask(DEPTH))[:, None] | decision.astype(np.uint64)).ravel(), return_inverse=True)
    weight = np.repeat(n, 8)
    ones = np.bincount(at, weights=weight * bit.ravel(), minlength=len(node))
    zeros = np.bincount(at, weights=weight, minlength=len(node)) - ones
    taken = lambda: np.where(bit.ravel() == 1, ones[at], zeros[at])
    log_w = log_kt(zeros, ones)
    total = (zeros + ones)[at]
    p = (taken() + 0.5) / (total + 1.0)
    for depth in range(DEPTH - 1, top - 1, -1):
        upper, to = np.unique((node & mask(depth)) | (node & np.uint64(255)), return_inverse=True)
        ones, zeros, below = (np.bincount(to, weights=x, minlength=len(upper)) for x in (ones, zeros, log_w))
        log_w, share = mixed(log_kt(zeros, ones), below)
        node, at, seen = upper, to[at], total > 0
        total = (zeros + ones)[at]
        estimate = (taken() + 0.5) / (total + 1.0)
        p = np.where(seen, share[at] * estimate + (1 - share[at]) * p, estimate)
    return (node, zeros, ones, log_w), at.reshape(bit.shape), p.reshape(bit.shape)


def some_roots(rows, most: int | None = None):
    """Rows of whole homes, in parts of about `most` keys: (rows from, to, keys, counts, keys by row)."""
    items, counts = rows.column("items").to_pylist(), rows.column("counts").to_pylist()
    sizes = np.cumsum([len(b) // 8 for b in items])
    first = 0
    while first < len(items):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + (most or ROOT_KEYS), "right")))
        keys, n = unpack(KEYS, items[first:last])
        yield first, last, keys.to_numpy(), np.concatenate([unpack_numbers(b) for b in counts[first:last]]).astype(np.int64), n
        first = last


def roots(top: int):
    """The nodes at depth top (NODES, without their share)."""

    def run(batches):
        for batch in batches:
            for _, _, keys, n, _ in some_roots(batch):
                (node, zeros, ones, log_w), _, _ = subtrees(keys, n, top)
                columns = (node >> np.uint64(8)).astype(np.int64), (node & np.uint64(255)).astype(np.int64), zeros, ones, log_w, np.ones(len(node))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names(NODES))

    return run


def weigh(batches):
    """log_w comes as the sum of the children's and becomes the node's own."""
    for b in batches:
        zeros, ones, below = (b.column(c).to_numpy() for c in ("zeros", "ones", "log_w"))
        log_w, share = mixed(log_kt(zeros, ones), below)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(log_w), pa.array(share)], names(NODES))


def paths(nodes: DataFrame, top: int) -> DataFrame:
    """(ctx, decision, a, b, s) at depth top - 1: bit 1 has probability a + b p where the depths from top on
    give it p, and s where training never reached them."""
    levels = [nodes]
    for depth in range(top - 1, -1, -1):
        ctx = F.col("ctx").bitwiseAND(F.lit((1 << (8 * depth)) - 1)).alias("ctx")
        sums = levels[-1].groupBy(ctx, "decision").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "log_w")])
        levels.append(materialise(sums.withColumn("share", F.lit(0.0)).mapInArrow(weigh, NODES), "nodes"))
    total = F.col("zeros") + F.col("ones")
    estimate, seen = (F.col("ones") + 0.5) / (total + 1.0), total > 0
    path = None
    for depth, level in enumerate(reversed(levels[1:])):
        if path is None:
            level = level.withColumns({"a0": F.lit(0.0), "b0": F.lit(1.0), "s0": F.lit(0.5)})
        else:
            ctx = F.col("ctx").bitwiseAND(F.lit((1 << (8 * (depth - 1))) - 1))
            level = level.withColumn("ctx0", ctx).join(path.toDF("ctx0", "decision", "a0", "b0", "s0"), ["ctx0", "decision"])
        rows = {"a": F.when(seen, F.col("a0") + F.col("b0") * F.col("share") * estimate).otherwise(F.col("s0")), "b": F.when(seen, F.col("b0") * (1 - F.col("share"))).otherwise(F.lit(0.0)), "s": F.when(seen, F.col("a0") + F.col("b0") * estimate).otherwise(F.col("s0"))}
        path = level.select("ctx", "decision", *[c.alias(n) for n, c in rows.items()])
    return path


def predictions(top: int):
    """ANSWERS of whole homes: log10 of the probability of each key's byte."""

    def run(batches):
        for batch in batches:
            path = batch.column("path")
            off, flat = path.offsets.to_numpy() - path.offsets[0].as_py(), path.flatten()
            decided, a, b, s = (flat.field(i).to_numpy() for i in range(4))
            for first, last, keys, n, per_row in some_roots(batch):
                (node, zeros, ones, _), at, p = subtrees(keys, n, top)
                decision, bit = decisions((keys & np.uint64(255)).astype(np.int64))
                row = np.repeat(np.arange(first, last), per_row)
                place = np.zeros((last - first, 256), np.int64)
                place[np.repeat(np.arange(last - first), np.diff(off[first : last + 1])), decided[off[first] : off[last]]] = np.arange(off[first], off[last])
                where = place[(row - first)[:, None], decision]
                seen = (zeros + ones)[at] > 0
                one = np.where(seen, a[where], s[where])
                weight = np.where(seen, b[where], 0.0)
                other = np.where(bit == 1, one, 1 - one - weight)
                logp = np.log10(np.maximum(other + weight * p, 1e-300)).sum(1).astype(np.float32)
                blobs = [x.tobytes() for x in np.split(logp, np.cumsum(per_row)[:-1])]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("kind", "home", "node", "items")), pa.array(blobs, pa.binary())], names(ANSWERS))

    return run


def plain_counts(batches):
    """ANSWERS of words: their counts."""
    for b in batches:
        values = [unpack_numbers(x).tobytes() for x in b.column("counts").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("kind", "home", "node", "items")), pa.array(values, pa.binary())], names(ANSWERS))


# Documents.


def document_scores(total: int, distinct: int, ends: int):
    def run(unit, answers):
        freed()
        size = np.array(unit.column("sizes")[0].as_py(), np.int64)
        data = np.frombuffer(pa.decompress(unit.column("items")[0].as_py(), unit.column("n")[0].as_py(), "zstd", asbytes=True), np.uint8)
        off, found = np.append(0, np.cumsum(size)), []
        for first, last, keys, n_keys, words, n_words in parts_of(data, off):
            found.append((first, last, (*coded(pa.array(keys)), n_keys), (*coded(words), n_words)))
        told = {}
        for k, kind in enumerate((KEYS, WORDS)):
            tally = Tally()
            for part in found:
                tally.add(part[2 + k][1], np.zeros(len(part[2 + k][1])))
            items, _, places = tally.total()
            own = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("home")
            values = np.zeros(len(items), np.float32 if kind == KEYS else np.int64)
            values[order_of(kind, items, 1)[0]] = np.frombuffer(b"".join(own.column("counts").to_pylist()), values.dtype)
            told[kind] = [values[at] for at in places]
        rows = len(size)
        score, base, known, tokens = np.zeros(rows), np.zeros(rows), np.zeros(rows, np.int64), np.ones(rows, np.int64)
        for (first, last, keys, words), logp, counts in zip(found, told[KEYS], told[WORDS]):
            score[first:last] = np.add.reduceat(logp[keys[0]].astype(float), np.cumsum(keys[2]) - keys[2])
            doc = np.repeat(np.arange(last - first), words[2])
            base[first:last] = np.bincount(doc, weights=np.log10(counts + 1.0)[words[0]], minlength=last - first)
            known[first:last] = np.bincount(doc, weights=(counts > 0)[words[0]], minlength=last - first)
            tokens[first:last] += words[2]
        base += log10(ends + 1.0) - tokens * log10(total + distinct + 1.0)
        bits = -score / log10(2.0) / (np.diff(off) + 1)
        columns = unit.column("ids")[0].as_py(), unit.column("held")[0].as_py(), tokens, known + (ends > 0), np.full(rows, total), base, score, bits
        kinds = pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names(OUT))

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """A row for each row of docs, see OUT."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    rows = materialise(docs.mapInArrow(describe, UNITS), "units", "kind")
    units = rows.where(F.col("kind") == TEXT)
    sums = units.select(F.count("*").alias("units"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("ends")).first()
    count, ends = sums["units"], sums["ends"] or 0

    level, steps, shares = 1, [], rows.where(F.col("kind") != TEXT).select(*names(SHARES))
    while True:
        count = max(1, ceil(count / FAN))
        steps.append(shares.withColumn("up", F.pmod(F.xxhash64("node"), F.lit(count))))
        level += 1
        shares = materialise(steps[-1].groupBy("kind", "home", "up").applyInArrow(merge(level), SHARES), "shares")
        if count == 1:
            break
    words, keys = shares.where(F.col("kind") == WORDS), shares.where(F.col("kind") == KEYS)
    sums = words.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, distinct = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)

    top = tail_bytes(level)
    nodes = materialise(keys.select("items", "counts").mapInArrow(roots(top), NODES), "nodes")
    path = paths(nodes, top).groupBy("ctx").agg(F.collect_list(F.struct("decision", "a", "b", "s")).alias("path"))  # 255 decisions at most
    above = F.col("home").bitwiseAND(F.lit((1 << (8 * (top - 1))) - 1))
    keys = keys.join(path, above == F.col("ctx")).select("kind", "home", "node", "items", "counts", "path")
    answers = keys.mapInArrow(predictions(top), ANSWERS).union(words.select(*names(ANSWERS)).mapInArrow(plain_counts, ANSWERS))
    for step in reversed(steps):
        level -= 1
        known = by_home(answers.withColumn("up", F.col("node")), level)
        answers = materialise(by_home(step.select("kind", "home", "node", "items", "up"), level).cogroup(known).applyInArrow(answer, ANSWERS), "answers")
    return units.select("node", "items", "n", "ids", "held", "sizes").groupBy("node").cogroup(answers.select("node", "kind", "home", "counts").groupBy("node")).applyInArrow(document_scores(total, distinct, ends), OUT)


def op7_language_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
