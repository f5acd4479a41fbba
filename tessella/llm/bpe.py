"""BPE encoding and decoding by a traversal of a trie of words (operator 12).

A text's words are encoded apart, so each Python task takes the distinct words of a slice of texts, and
encodes those that it has not met before. They are inserted into a trie of symbols. A depth-first walk gives each node
its last-token state: the token that ends the encoding of the path to it. A token that ends there is that token if it stands
beside the state of the node where it begins, which it does if merging the two alone leaves both whole; so a
node costs a few look-ups, and a beginning that many words share is encoded once. The states on the way
back from a word's end are its tokens.

Edge cases: null and empty texts have no tokens and decode to an empty text; a text that spells a special token has
that token there, as the tokenizer does it; texts of any length are cut between words only, a word of any
length is walked symbol by symbol; repeated rows are encoded each; null ids are kept as they are; an empty table gives
an empty table. Other columns pass through `encode` and `decode`, but one named like the result is replaced."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, split_words, text_bytes
from .packing import KINDS, tokenizer_path

END = "</w>"
#: Words, and pairs of tokens, that a Python worker remembers; each table starts anew beyond that.
REMEMBERED = 600_000
#: Printable ASCII, of which the pieces are known without the tokenizer's normal form.
PLAIN = re.compile("[!-~]*")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class Merges:
    """The merge table: what merging does to a few symbols, and which tokens stand side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        self.vocabulary = vocabulary
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        #: What a token may begin with, and for each such beginning and next symbol the beginning that follows
        #: it and the tokens that end there, the longest first.
        self.begin = {t[:k] for t in vocabulary for k in range(1, len(t.removesuffix(END)))}
        self.steps: dict[str, tuple[str, tuple[str, ...]]] = {}
        self.known: dict[tuple[str, str], bool] = {}

    def merged(self, *tokens: str) -> list[str]:
        """The tokens' symbols after all merges, the first in rank first."""
        parts: list[str] = []
        for t in tokens:
            stem = t.removesuffix(END)
            parts += stem
            if stem != t:
                parts[-1] += END
        rank, none = self.rank.get, len(self.rank)
        order = [rank(p, none) for p in zip(parts, parts[1:])]
        while order and (first := min(order)) < none:
            i = order.index(first)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(order):
                order[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def step(self, path: str) -> tuple[str, tuple[str, ...]]:
        if len(self.steps) > REMEMBERED:
            self.steps.clear()
        ends = [path[k:] for k in range(len(path.removesuffix(END)))]
        after = next((e for e in ends if e in self.begin), "")
        self.steps[path] = step = after, tuple(e for e in ends if e in self.vocabulary)
        return step

    def beside(self, before: str, token: str) -> bool:
        """Whether both stay whole side by side; before "" asks for token alone."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fits = self.known[before, token] = self.merged(*filter(None, (before, token))) == [t for t in (before, token) if t]
        return fits


def encodings(words: list[str], merges: Merges) -> dict[str, list[str]]:
    """Tokens of each distinct word of byte characters, by a depth-first walk over the trie of all."""
    root: dict = {}
    for w in words:
        node = root
        for symbol in w[:-1]:
            node = node.setdefault(symbol, {})
        node[w[-1] + END] = w  # an end that no other word goes on from
    found: dict[str, list[str]] = {}
    last, size = [""], [0]  # the state at each depth of the path, and its symbols
    walk = [(0, symbol, below) for symbol, below in root.items()]
    paths = [""]  # as much of the path to each depth as a token may begin with
    steps, known = merges.steps, merges.known
    while walk:
        depth, symbol, below = walk.pop()
        path = paths[depth] + symbol
        after, tokens = steps.get(path) or merges.step(path)
        for token in tokens:
            n = len(token) - len(END) if token.endswith(END) else len(token)
            before = last[depth + 1 - n]
            fits = known.get((before, token))
            if fits or fits is None and merges.beside(before, token):
                break
        else:
            raise ValueError(f"the vocabulary has no token for the end of {path!r}")
        depth += 1
        del last[depth:], size[depth:], paths[depth:]
        last.append(token)
        size.append(n)
        if isinstance(below, str):
            found[below] = own = []
            while depth:
                own.append(last[depth])
                depth -= size[depth]
            own.reverse()
        else:
            paths.append(after)
            walk += [(depth, s, b) for s, b in below.items()]
    return found


class Encoder:
    """ids of the words of a text, remembered by word and by piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)  # for the normal form of words beyond ASCII
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")" if self.special else "(?!)()")
        self.vocabulary = spec["model"]["vocab"]
        self.merges = Merges({t: i for t, i in self.vocabulary.items() if t not in self.special}, spec["model"]["merges"])
        self.known: dict[bytes, bytes] = {}

    def split(self, word: str) -> list[str]:
        """Pieces, in byte characters, and special tokens of a run without white space."""
        out: list[str] = []
        for part in self.cut.split(word):
            if part in self.special:
                out.append(part)
            elif PLAIN.fullmatch(part):
                out += PIECES.findall(part.lower())
            else:
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))]
        return out

    def learn(self, words: list[bytes]) -> None:
        split = [self.split(w.decode("utf-8", "replace")) for w in words]
        found = encodings(list({p for pieces in split for p in pieces if p not in self.special}), self.merges)
        coded = {p: np.array([self.vocabulary[t] for t in tokens], np.int32).tobytes() for p, tokens in found.items()}
        coded |= {special: np.array([i], np.int32).tobytes() for special, i in self.special.items()}
        self.known.update((word, b"".join(map(coded.__getitem__, pieces))) for word, pieces in zip(words, split))

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as a list."""
        data, off = text_bytes(texts)
        if any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            words, counts = split_words(data, off)
        else:  # fewer distinct words: lower case and without punctuation
            upper = (data >= 65) & (data <= 90)
            upper[:-1] &= data[1:] < 128  # a following mark may combine with one case only
            words, counts = split_words(np.where(upper, data + 32, data).astype(np.uint8), off, KINDS)
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        fresh = [w for w in names if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = names
        self.learn(fresh)
        raws = list(map(self.known.__getitem__, names))
        ends = np.append(0, np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))) // 4
        lists = pa.LargeListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(raws), np.int32)))
        taken = lists.take(coded.indices.cast(pa.int64()))
        stops = taken.offsets.to_numpy()[np.append(0, np.cumsum(counts))] if len(taken) else np.zeros(len(texts) + 1, np.int64)
        return pa.LargeListArray.from_arrays(stops - stops[0], taken.flatten()).cast(pa.list_(pa.int32()))


def placed(df: DataFrame, name: str, kind: str) -> tuple[list, str]:
    """The other columns of df, and the schema with the new one after them."""
    others = [c for c in df.columns if c.lower() != name.lower()]
    return others, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others), f"`{name}` {kind}"])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column `text` as a list of token ids under the name `ids`."""
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (text, ids)], F.col(f"`{text}`").cast("string").alias(ids))
    others, schema = placed(rest, ids, "array<int>")

    def run(batches):
        encoder = None
        for batch in batches:
            for part in slices(batch, ids):
                encoder = encoder or shared(path)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], encoder.encode(part.column(ids))], [*others, ids])

    return rest.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the list of token ids as text: tokens as the vocabulary spells them, one space between."""
    rest = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in (text, ids)], F.col(f"`{ids}`").alias(text))
    others, schema = placed(rest, text, "string")

    def run(batches):
        table = None
        for batch in batches:
            table = table or spellings(path)
            lists = batch.column(text)
            for a in range(0, batch.num_rows, 256):
                part = lists.slice(a, 256)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, 256) for c in others], spelt(part, table)], [*others, text])

    return rest.mapInArrow(run, schema)


def spellings(path: str) -> pa.Array:
    """Each id's token and a space after it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    table = [""] * (max(tokens.values()) + 1)
    for t, i in tokens.items():
        table[i] = t + " "
    return pa.array(table, pa.large_string())


def spelt(lists: pa.Array, table: pa.Array) -> pa.Array:
    ends = np.append(0, np.cumsum(np.fromiter((len(x) if x.is_valid else 0 for x in lists), np.int64, len(lists))))
    taken = table.take(lists.flatten())
    raw = taken.buffers()[2]
    view, at = memoryview(raw or b""), np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][: len(taken) + 1]
    stops = (at[ends] if len(taken) else ends).tolist()
    return pa.array([bytes(view[a : b - 1]).decode() if b > a else "" for a, b in zip(stops, stops[1:])], pa.string())


_encoders: dict[str, Encoder] = {}


def shared(path: str) -> Encoder:
    """The encoder of this Python worker, which later tasks find with what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = str(tokenizer_path())
    ids = encode(docs, path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    told = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return decode(told, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
