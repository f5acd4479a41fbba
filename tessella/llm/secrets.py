"""Secret scans (operator 2).

Three kinds are found by their form (assign, access, hex). Beyond these, candidate strings are judged by
the Shannon entropy of a window that slides over them: counts are kept per character and changed by
one character in and one out, so that each step costs the same. Each character class has its threshold;
windows that reach it join into spans entropy_hex, entropy_alnum and entropy_base64. An allow-list
suppresses candidates that are known not to be secrets (paths and plain words as a whole; UUIDs and placeholders for the
piece between slashes or equals signs that they stand in, so that a secret beside them is found).

Offsets count code points. Edge cases: null and empty texts have no spans; null ids are kept as they are; repeated rows are scanned
each; texts are scanned whole in one pass, whatever their length; an empty table gives an empty result; extra columns are
ignored."""

from __future__ import annotations

import re
from hashlib import sha256
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The forms of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # what is shorter fails, and fails from any later start in the same run
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")

#: Bits per character that a window must reach, by class of the candidate.
WINDOW = 20
THRESHOLD = {"entropy_hex": 3.1, "entropy_alnum": 3.6, "entropy_base64": 3.8}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES = (("entropy_hex", re.compile(r"[0-9A-Fa-f]+")), ("entropy_alnum", re.compile(r"[A-Za-z0-9]+")))
#: Candidates that are let go: words, numbers, identifiers of words, paths. Possessive, as a run of separators could
#: else be cut in as many ways as it has subsets.
ALLOW = re.compile(r"[A-Za-z]+|[0-9]+|[A-Za-z]*+[0-9]{0,4}+(?:[_/=+-]++[A-Za-z]*+[0-9]{0,4}+)*+")
#: Pieces of a candidate, and those that are let go by themselves: with a placeholder in them, and UUIDs.
PIECE = re.compile(r"[^/=]+")
CLEARED = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|.*(?:EXAMPLE|example|placeholder|xxxxxx|XXXXXX|0123456789|abcdefgh).*")
COST = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]


def hot_windows(s: str, threshold: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Unions of the windows of s whose entropy reaches the threshold."""
    counts: dict[str, int] = {}
    sum_nlogn, spans = 0.0, []
    most = (log2(width) - threshold) * width + 1e-9  # entropy = log2(w) - sum(n log n) / w
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        sum_nlogn += COST[n + 1] - COST[n]
        counts[c] = n + 1
        if i >= width - 1:
            if sum_nlogn <= most:
                a = i - width + 1
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((a, i + 1))
            old = s[i - width + 1]
            n = counts[old]
            sum_nlogn += COST[n - 1] - COST[n]
            counts[old] = n - 1
    return spans


def judged(s: str) -> list[tuple[int, str]]:
    """The parts of a candidate that no rule lets go, and where they start. A piece between slashes or equals signs that
    is let go cuts the candidate in two."""
    if ALLOW.fullmatch(s):
        return []
    ends, start = [], 0
    for m in PIECE.finditer(s):
        if CLEARED.fullmatch(m[0]):
            ends.append((start, m.start()))
            start = m.end()
    parts = [(a, s[a:b]) for a, b in [*ends, (start, len(s))] if b - a >= WINDOW]
    return [(a, part) for a, part in parts if not (ends and ALLOW.fullmatch(part))]


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start and then by kind in the order of KINDS."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        for start, part in judged(m[0]):
            kind = next((k for k, form in CLASSES if form.fullmatch(part)), "entropy_base64")
            found += [(kind, m.start() + start + a, m.start() + start + b) for a, b in hot_windows(part, THRESHOLD[kind])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_table(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text, and spans as array<struct<kind, start, end>>."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t.as_py() or "")] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, spans)], ["doc_id", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
