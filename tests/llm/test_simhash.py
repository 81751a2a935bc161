"""SimHash, vantage-point trees, components and deduplication against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlake.llm import components, simhash


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most):
    prints = np.array(prints, np.uint64)
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= most):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(prints))]


def texts():
    rnd = random.Random(3)
    base = [" ".join(rnd.choice(["tea", "Cup", "ÄRGER", "réd", "x,y"]) + str(rnd.randrange(300)) for _ in range(120)) for _ in range(6)]
    near = [b.replace(b.split()[k], "other", 1) for b in base for k in (3, 70)]
    return [*base, *near, base[0], base[0].lower(), "", None, " \n\t", "one two", "ONE  TWO", "a b c d", "z " * 5000, "\x0b\x0cword\x1cx word"]


def test_fingerprints(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    out = spark.createDataFrame(rows, "k int, t string").select("k", simhash.hex_of(simhash.simhash("t")).alias("f")).collect()
    assert {r.k: r.f for r in out} == {k: f"{plain_fingerprint(t):016x}" for k, t in rows}


@pytest.mark.parametrize("depth", [0, 3, 9])
def test_tree_reaches_every_leaf_of_the_ball(depth):
    rnd = np.random.default_rng(depth)
    tree = simhash.Tree(rnd.integers(0, 300, 2000).astype(np.uint16), depth, 1, 5)
    for v in rnd.integers(0, 65536, 300):
        ball = {int(v), *(int(v) ^ 1 << b for b in range(16))}
        reached = {int(tree.home[v]), *tree.others[tree.first[v] : tree.first[v + 1]].tolist()}
        # A leaf of the ball is reached from here, or its own member reaches this leaf.
        for u in ball:
            back = tree.others[tree.first[u] : tree.first[u + 1]].tolist()
            assert tree.home[u] in reached or tree.home[v] in back
        assert all(x >= tree.home[v] for x in reached)


@pytest.mark.parametrize("per_leaf, block", [(10_000, 8192), (4, 8192), (4, 60)])
def test_links_close_to_all_pairs(spark, per_leaf, block):
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**64, 120, np.uint64)
    chain = [base[0]]
    for b in range(60):
        chain.append(chain[-1] ^ np.uint64(1 << (b % 64)) ^ np.uint64(1 << ((b * 7 + 3) % 64)))
    dense = [base[1] ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(12) for b in range(20, 32)]
    flips = [b ^ np.uint64(sum(1 << int(x) for x in rnd.choice(64, k, replace=False))) for b in base[2:60] for k in (3, 4, 5)]
    prints = np.unique(np.array([*base, *chain, *dense, *flips], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint")
    links = simhash.near_links(df, 4, per_leaf, block)
    for r in links.collect():
        assert r.a != r.b
    roots = {r.node: r.root for r in components.components(links, "a", "b").collect()}
    want = brute_components(prints, 4)
    got = [roots.get(int(x), int(x)) for x in prints.view(np.int64)]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_chains_stars_and_rings(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    edges += [(5, 5), (None, 7), (3001, None)]
    names = list(range(4000))
    rnd.shuffle(names)
    edges = [(None if a is None else names[a], None if b is None else names[b]) for a, b in edges]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    for group in (range(201), range(1000, 1300), range(2000, 2050)):
        own = [names[x] for x in group]
        assert {out[x] for x in own} == {min(own)}
    assert len(out) == 201 + 300 + 50


def test_components_of_documents_and_deduplication(spark):
    rows = [(k * 3 % 31, t, "L", k) for k, t in enumerate(texts())]
    rows += [(2, "same id, other text", "L", 1), (2, "same id, other text", "L", 1), (None, "null id", "L", 1), (None, "null id", "M", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, root int")
    prints = df.select("doc_id", simhash.simhash("text").alias("fp"))
    found = simhash.near_components(prints)
    got = {r.fp: r.component_id for r in found.collect()}
    plain = [plain_fingerprint(r[1]) for r in rows]
    want = brute_components(plain, 4)
    for k, f in enumerate(plain):
        ids = [rows[j][0] for j in range(len(rows)) if want[j] == want[k] and rows[j][0] is not None]
        assert got[int(np.uint64(f).view(np.int64))] == (min(ids) if ids else None)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    left = kept.collect()
    assert len(left) == len(set(want))
    assert {tuple(r) for r in left} <= set(rows)
    for r in left:
        k = next(j for j, x in enumerate(rows) if x == tuple(r))
        ids = [rows[j][0] for j in range(len(rows)) if want[j] == want[k] and rows[j][0] is not None]
        assert r.doc_id == (min(ids) if ids else None)
    assert simhash.deduplicated(df.limit(0)).count() == 0
    assert simhash.near_components(prints.limit(0)).count() == 0
