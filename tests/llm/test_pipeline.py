"""The pipeline stage by stage against brute force on its own input."""

import collections
import random

from test_operators import TEXTS, fingerprint, personal, words_of  # noqa: F401

import corpus_pipeline as P
from tessella.llm import mixing, packing, simhash, toxicity


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    clean = stages["toxicity"](spark, docs, sf_dir)
    rejected = {r.doc_id for r in toxicity.scored(docs, labels).where("toxicity >= 0.5").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - rejected
    single = stages["near_duplicates"](spark, clean, sf_dir)
    groups = {r.component_id for r in simhash.near_duplicates(clean).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(groups)
    private = stages["personal_data"](spark, single, sf_dir)
    assert private.count() == single.count() and not any(personal(r.text) for r in private.collect())
    mixed = stages["mixing"](spark, private, sf_dir)
    taken = {r.row.doc_id: r.n for r in mixing.copies(private).collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({i: n for i, n in taken.items() if n})
    for df in (clean, single, private, mixed):
        assert df.columns == docs.columns
    packed = stages["packing"](spark, mixed, sf_dir)
    want = packing.pieces(mixed, str(packing.tokenizer_path())).drop("ids_crc32").collect()
    assert collections.Counter(tuple(r) for r in packed.select("doc_id", "piece", "start", "length").collect()) == collections.Counter(map(tuple, want))


def test_near_copies_go(spark, sf_dir):
    """Planted copies with edited words, about a common text and in chains, against the sets themselves."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioutrnsdl") for _ in range(rng.randint(3, 9)))
    texts = []
    for n in (6, 40, 90, 400):
        for _ in range(12):
            base = [word() for _ in range(n)]
            texts.append(base)
            for edits in (1, 2, 3, 5, 9, n // 60, n // 45):
                copy = list(rng.choice([base, texts[-1]]))
                for _ in range(edits):
                    copy[rng.randrange(n)] = word()
                texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    part = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((part[i], part[j]))
                part = [a if p == b else p for p in part]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = dict(P.STAGES)["near_duplicates"](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(part)) and len(set(part)) < 0.9 * len(texts)


def test_run(spark, sf_dir):
    rows = P.run(spark, sf_dir).collect()
    assert rows and max(r.length for r in rows) <= 4096
