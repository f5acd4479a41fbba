"""Toxicity scores from a lexicon that tolerates misspelling (operator 8).

Learning looks at a bounded sample of labelled rows (TRAIN_ROWS, drawn by a hash of doc_id and text): for words and
word beginnings the documents of either label are counted, and those that stand out with toxic ones
form the lexicon (LEXICON entries at most, beside a few fixed words). The lexicon is a trie. A word's
Levenshtein automaton is run along the trie, a row of edit distances per node, and branches that no
accepting state can follow are left; whole words of five characters and more tolerate one edit. Distinct words
are looked up once per slice, behind a filter that keeps every word which holds one half of an entry intact
(an edit can only touch the other half).

Each hit is judged in its context: quotation marks round it or reporting words near it speak for a
quotation, words of address and repetition for abuse. A logistic regression over these sums, fitted on the
same bounded sample, gives the score.

Edge cases: null and empty texts have no hit and get the score of such texts; labels that are null are not
learned from; without labels fixed weights hold; repeated rows are scored each and learned from once; null doc_ids count as
training ids; an empty table gives an empty result. Extra columns pass through `score`, whatever their names."""

from __future__ import annotations

import re
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, fresh, materialise, slices, split_words, text_bytes

FOLDS, HELD = 5, 0
TRAIN_ROWS, LEXICON, LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 20_000, 200, 3, 0.02, 3.0
#: Parts that the sample is dealt to, as its rows cost far more to read than their bytes tell.
SAMPLE_PARTS = 48
#: Bytes of text that a task works on at a time, and stems that it counts before it passes the counts on.
PART_BYTES, HELD_STEMS = 1 << 20, 100_000
STEMS, FUZZY_LENGTH, WINDOW, SPAN = range(4, 9), 5, 5, 40

# Words that the lexicon always has, words of reporting, words of address.
SEEDS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "scum", "trash", "clown")
REPORTING = frozenset((b"said", b"says", b"called", b"wrote", b"quoted", b"quote", b"quoting", b"term", b"insult", b"slur", b"reported", b"according"))
ADDRESS = frozenset((b"you", b"your", b"youre", b"yours", b"he", b"she", b"they", b"all"))
QUOTES = re.compile(b"[\"`]|\xe2\x80[\x9c\x9d\x9e]|\xc2[\xab\xbb]")

#: ASCII letters, digits and all bytes beyond ASCII make words.
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
FEATURES = 6
DEFAULT = [-4.0, 3.0, 1.5, 0.5, 0.2, -1.0]


def training(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) != HELD, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of different labelled training rows, about `most` at most."""
    own = labels.where(training(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = materialise(own, "labels")
    few = lambda df, n, *key: df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 20)) < int(min(1.0, most / max(1, n)) * (1 << 20)))
    own = few(own, own.count(), F.col("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(own, "doc_id")
    rows = materialise(rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).repartition(SAMPLE_PARTS, "doc_id", "h"), "rows")
    return few(rows, rows.count(), F.lit(1), "doc_id", "h").select("text", "toxic")  # ids that repeat bring more rows than labels


def document_words(texts: pa.Array):
    data, off = text_bytes(texts)
    data = LOWER[data]
    words, counts = split_words(data, off, KINDS)
    return data, off, words, counts


def stems_of(words) -> set[str]:
    """The words of four characters and more, with $ at their end, and their beginnings."""
    long = [w for w in (w.decode(errors="replace") for w in words) if len(w) > 3]
    return {f"{w}$" for w in long} | {w[:k] for w in long for k in STEMS if len(w) >= k}


def count_stems(only: frozenset[str] | None):
    """(stem, n): documents that hold it, of all stems or of some, in parts to be summed. The stem "" counts all documents."""

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["stem", "n"])

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for part in slices(b, "text", PART_BYTES):
                _, _, words, counts = document_words(part.column("text"))
                words, at = words.to_pylist(), 0
                for n in counts.tolist():
                    stems = stems_of(set(words[at : at + n]))
                    at += n
                    seen.update(stems if only is None else only.intersection(stems))
                    seen[""] += 1
                if len(seen) > HELD_STEMS:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    return run


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Entry -> log odds, from (text, toxic) rows, TRAIN_ROWS at most."""

    def counted(which: str, only=None, least: int = 1) -> dict[str, int]:
        counts = rows.where(which).select("text").mapInArrow(count_stems(only), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
        return {r["stem"]: r["n"] for r in counts.where(F.col("n") >= least).collect()}

    # Stems in enough toxic rows: few, as the sample is bounded. Clean rows count for these alone.
    n_toxic = rows.where("toxic > 0").count()
    held = counted("toxic > 0", None, max(LEAST_DOCS, int(LEAST_SHARE * n_toxic)))
    held.pop("", None)
    clean = counted("toxic <= 0", frozenset(held))
    n_clean = clean.pop("", 0)
    odds = {s: log((n + 0.5) / (n_toxic + 1)) - log((clean.get(s, 0) + 0.5) / (n_clean + 1)) for s, n in held.items()}
    found = dict(sorted(((s, (held[s], o)) for s, o in odds.items() if o >= LEAST_ODDS), key=lambda x: (-x[1][1], x[0]))[: 10 * LEXICON])
    # A beginning that one longer entry explains gives way to it; of the rest, what extends another goes.
    longer: dict[str, int] = {}
    for s, (n, _) in found.items():
        for k in range(1, len(s)):
            longer[s[:k]] = max(n, longer.get(s[:k], 0))
    left = {s: v for s, v in found.items() if longer.get(s, 0) < 0.9 * v[0]}
    kept = {s: v for s, v in left.items() if not any(s[:k] in left for k in range(1, len(s.rstrip("$")) + s.endswith("$")))}
    best = sorted(kept.items(), key=lambda x: (-x[1][1], x[0]))[:LEXICON]
    strongest = max((v[1] for _, v in best), default=4.0)
    return {f"{w}$": strongest for w in SEEDS} | {s: v[1] for s, v in best}


class Trie:
    """Lexicon as nested dictionaries; None marks an entry as (entry, edits allowed, whole word)."""

    def __init__(self, entries):
        self.root: dict = {}
        self.memory: dict[str, tuple[str, int] | None] = {}
        heads, tails, forms = set(), set(), set()
        for e in entries:
            term, whole = e.rstrip("$"), e.endswith("$")
            edits = 1 if whole and len(term) >= FUZZY_LENGTH else 0
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node.setdefault(None, []).append((e, edits, whole))
            half, end = len(term) // 2 if edits else len(term), "$" if whole else ""
            head, tail = re.escape(term[:half]), re.escape(term[half:])
            heads.add(head)
            if edits:
                tails.add(tail)
                rest = len(term) - half
                forms |= {f"{head}.{{{rest - 1},{rest + 1}}}{end}", f".{{{half - 1},{half + 1}}}{tail}{end}"}
            else:
                forms.add(head + end)
        # Two steps: a cheap look at either end of a word, then the lengths.
        self.ends = "|".join(f for f in ("^(?:" + "|".join(sorted(heads)) + ")" if heads else "", "(?:" + "|".join(sorted(tails)) + ")$" if tails else "") if f) or "^$."
        self.forms = "^(?:" + "|".join(sorted(forms)) + ")" if forms else "^$."

    def match(self, word: str) -> tuple[str, int] | None:
        """The entry that the word spells with the fewest edits, and how many."""
        if word in self.memory:
            return self.memory[word]
        best, stack = None, [(self.root, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            for c, below in node.items():
                if c is None:
                    for e, edits, whole in below:
                        d = row[-1] if whole else min(row)
                        if d <= edits and (best is None or (d, e) < (best[1], best[0])):
                            best = (e, d)
                    continue
                new = [row[0] + 1]
                for j, w in enumerate(word):
                    new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (w != c)))
                if min(new) <= 1:
                    stack.append((below, new))
        if len(self.memory) > 200_000:
            self.memory.clear()
        self.memory[word] = best
        return best


def features(texts: pa.Array, trie: Trie, odds: dict[str, float]) -> np.ndarray:
    """A row for each text: 1, weighed exact and misspelled hits, strongest hit, hits among words, quotations."""
    data, off, words, counts = document_words(texts)
    x = np.zeros((len(texts), FEATURES))
    x[:, 0] = 1
    if not len(words):
        return x
    coded = words.dictionary_encode()
    names = coded.dictionary.cast(pa.large_string())
    near = np.flatnonzero(pc.match_substring_regex(names, trie.ends).to_numpy(zero_copy_only=False))
    close = names.take(pa.array(near))
    fits = pc.match_substring_regex(close, trie.forms)
    hit: dict[int, tuple[str, int]] = {}
    for i, w in zip(near[fits.to_numpy(zero_copy_only=False)].tolist(), close.filter(fits).to_pylist()):
        if m := trie.match(w):
            hit[i] = m
    if not hit:
        return x
    flags = np.zeros(len(names), bool)
    flags[list(hit)] = True
    codes = coded.indices.to_numpy()
    at = np.flatnonzero(flags[codes])
    ends = np.cumsum(counts)
    k = KINDS[data] > 0
    first = k.copy()
    first[1:] &= ~k[:-1]
    starts_of = off[:-1][(off[:-1] < len(data))]
    first[starts_of] = k[starts_of]
    where = np.flatnonzero(first)
    tally: dict[int, list] = {}
    for i, d in zip(at.tolist(), np.searchsorted(ends, at, "right").tolist()):
        entry, edits = hit[int(codes[i])]
        begin, end = int(ends[d] - counts[d]), int(ends[d])
        around = {w for w in words[max(begin, i - WINDOW) : min(end, i + WINDOW + 1)].to_pylist()}
        p = int(where[i])
        before, after = bytes(data[max(int(off[d]), p - SPAN) : p]), bytes(data[p : min(int(off[d + 1]), p + SPAN)])
        quoted = bool(QUOTES.search(before) and QUOTES.search(after)) or bool(REPORTING & around)
        weight = odds[entry] * (0.25 if quoted else 1.0) * (1.25 if ADDRESS & around else 1.0)
        t = tally.setdefault(d, [0.0, 0.0, 0.0, 0, 0])
        t[1 if edits else 0] += weight
        t[2] = max(t[2], weight)
        t[3] += 1
        t[4] += quoted
    for d, (exact, fuzzy, most, n, quoted) in tally.items():
        x[d, 1:] = np.log1p(exact), np.log1p(fuzzy), most, 100 * n / counts[d], quoted / n
    return x


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method."""
    if len(y) < 10 or y.min() == y.max():
        return np.array(DEFAULT)
    w, hold = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    hold[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, labels: DataFrame, name: str = "toxicity") -> DataFrame:
    """docs with a column (0 to 1) of that name, which docs must not have."""
    rows = materialise(sample(docs, labels), "sample")
    odds = learn_lexicon(rows)

    def describe(batches):
        trie = Trie(odds)
        for b in batches:
            for part in slices(b, "text", PART_BYTES):
                x = features(part.column("text"), trie, odds)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column("toxic")], ["x", "toxic"])

    learned = rows.mapInArrow(describe, "x array<double>, toxic int").collect()  # TRAIN_ROWS short rows at most
    weights = fit(np.array([r["x"] for r in learned]).reshape(-1, FEATURES), np.array([float(r["toxic"] > 0) for r in learned]))
    text = fresh(docs, "text")

    def run(batches):
        trie = Trie(odds)
        for b in batches:
            for part in slices(b, text, PART_BYTES):
                z = features(part.column(text), trie, odds) @ weights
                yield pa.RecordBatch.from_arrays([*(c for n, c in zip(part.schema.names, part.columns) if n != text), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*(n for n in part.schema.names if n != text), name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a column `toxicity`, which replaces one of that name."""
    name = fresh(docs, "toxicity")
    return scored(docs, labels, name).withColumn("toxicity", F.col(name)).drop(*([name] if name != "toxicity" else []))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score below one half."""
    name = fresh(docs, "toxicity")
    return scored(docs, labels, name).where(F.col(name) < 0.5).drop(name)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return scored(docs, labels, "score").select("doc_id", (~training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
