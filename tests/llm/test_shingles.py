"""Near copies by shingle similarity against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import shingles


def plain_set(text, k=5):
    words = (text or "").split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_groups(texts, least=0.8):
    sets, label = [plain_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or (a and len(a & sets[j]) >= least * len(a | sets[j])):
                label = [label[j] if x == label[i] else x for x in label]
    return label


def copies():
    """Texts with copies of a similarity from 0.7 to 1, chains of copies, and texts that share a passage only."""
    rnd = random.Random(9)
    words = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    out, common = [], words(60)
    for k in range(60):
        base = words(rnd.randrange(60, 400))
        out.append(base)
        for share in (0.004, 0.012, 0.02, 0.03):
            out.append([w if rnd.random() > share else "other" for w in base])
    for _ in range(20):
        out.append(out[-1][12:] + words(12))
        out.append(words(80) + common)
    return [" ".join(x) for x in out] + ["", None, " \n", "one two", "one two", "one two three"]


@pytest.mark.parametrize("block", [shingles.BLOCK, 500])
def test_near_copies(spark, block):
    texts = copies()
    want = plain_groups(texts)
    sets = [plain_set(t) for t in texts]
    pairs = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b]
    assert sum(0.8 <= s < 0.95 for s in pairs) > 40 and sum(0.65 <= s < 0.8 for s in pairs) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = shingles.deduplicated(docs, block=block)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({g: want.index(g) for g in want}.values())


def test_stage_takes_similarity_of_four_fifths(spark):
    """Copies at 0.8 to 0.95 of one text; most differ in more than four bits of a fingerprint."""
    texts = [t for t in copies() if t and len(t.split()) > 50][:100]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == len(set(plain_groups(texts)))


def test_fingerprints_find_copies_without_bands(spark):
    """SimHash is a step of its own: sets that are similar and within BITS bits are linked though no band brings them together."""
    texts = list(dict.fromkeys(t for t in copies() if t and len(t.split()) > 50))[:100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("__row", F.col("doc_id").cast("bigint"))
    nodes = docs.select(F.col("__row").alias("row"), shingles.sketch("text", 5).alias("s")).select("row", "s.*")
    place = {r.node: r.row for r in nodes.collect()}
    sets, prints = [plain_set(t) for t in texts], {r.row: r.fp for r in nodes.collect()}
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    close = {(i, j) for i in range(len(texts)) for j in range(i) if near(i, j) and ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= shingles.BITS}
    found = shingles.near_links(docs, nodes.withColumn("bands", F.array().cast("array<bigint>")), "text", 5, 0.8).collect()
    label = {k: k for k in range(len(texts))}
    for a, b in ((place[r.a], place[r.b]) for r in found):
        label = {k: label[b] if v == label[a] else v for k, v in label.items()}
    wanted = plain_groups(texts)
    assert len(close) > 20 and all(label[i] == label[j] for i, j in close)
    assert all(wanted[i] == wanted[j] for i in label for j in label if label[i] == label[j])


def test_empty(spark):
    assert shingles.deduplicated(spark.createDataFrame([], "doc_id int, text string")).count() == 0
