"""Packing, token ids, the length histogram and the mix against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.llm import histogram, mixing, packing, tokens

DOCS = "doc_id bigint, text string, lang string, source string, length string, sequence_id string, Budget string"


@pytest.fixture(scope="module")
def real():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def docs(spark):
    rnd = random.Random(5)
    words = ["Alpha", "beta,", "it's", "naïve", "10.5", "<|endoftext|>", "ﬁn", "***", "Ünï"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 40, 300]))) for _ in range(60)]
    texts += [None, "", " \n ", "word " * 3000, texts[5], texts[5]]
    rows = [(k, t, rnd.choice(["en", "de", None]), f"src{k % 7}", "x", "y", "z") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", "en", None, "x", "y", "z")]
    return rows, spark.createDataFrame(rows, DOCS)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ' ́İẞsStT<|>\x1c")), max_size=30))
def test_ids_are_those_of_the_tokenizer(real, text):
    want = np.array(real.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert tokens.WordEncoder.ids(encoder(), text) == want
    assert encoder().ids(text) == want  # from the cache


def encoder(found=[]):  # noqa: B006
    if not found:
        found.append(tokens.WordEncoder())
    return found[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_never_overfills_and_leaves_one_small_bin(lengths):
    lengths.sort(reverse=True)
    bins, offsets, fills = packing.best_fit(lengths, 50)
    inside = Counter()
    for n, b, at in zip(lengths, bins, offsets):
        assert inside[b] == at
        inside[b] += n
    assert [inside[b] for b in range(len(fills))] == fills and all(f <= 50 for f in fills)
    assert sum(2 * f <= 50 for f in fills) <= 1


@pytest.mark.parametrize("per_partition", [10_000, 9])
def test_pack_of_documents(spark, real, per_partition):
    rows, df = docs(spark)
    out = packing.pack(tokens.pieces(df, "doc_id", "text", 128), 128, items_per_partition=per_partition, fan=2).collect()
    want = Counter()
    for r in rows:
        ids = [*real.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 128):
            own = np.array(ids[k : k + 128], "<u4")
            want[(r[0], k // 128, k, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    filled = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 128
    together = packing.best_fit(sorted((r.length for r in out), reverse=True), 128)[2]
    assert len(filled) <= len(together) + (0 if per_partition > len(out) else len(out) // per_partition)


def test_pack_merges_small_bins_up_the_tree(spark):
    """Items of one length, dealt over many partitions: each has a bin that is not full, and the tree joins them."""
    items = spark.range(640).select("id", F.lit(30).cast("bigint").alias("length"), F.lit(1).alias("Sequence_ID"))
    out = packing.pack(items, 100, items_per_partition=10, fan=3, slack=0)
    got = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert got.where("n <> end or n > 100").count() == 0
    assert got.count() <= 640 / 3 + 4 and out.count() == 640


def test_pack_edges(spark):
    empty = spark.createDataFrame([], "id int, length bigint")
    assert packing.pack(empty, 10).count() == 0
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(spark.createDataFrame([(1, 11)], "id int, length bigint"), 10).collect()


def test_histogram(spark, real):
    rows, df = docs(spark)
    lengths = [len(real.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    found = histogram.length_histogram(df)
    for r in found.collect():
        assert r.n_docs == lengths.count(r.length) > 0 and r.n_tokens == r.n_docs * r.length
        assert r.docs_at_most == sum(n <= r.length for n in lengths) and r.docs_longer == len(lengths) - r.docs_at_most
        assert r.tokens_longer == sum(n for n in lengths if n > r.length)
        assert r.truncated_tokens == sum(min(n, r.length) for n in lengths)
    assert found.count() == len(set(lengths))
    cuts = {r.context: (r.truncated_tokens, r.docs_cut) for r in histogram.truncated_totals(found, [0, 7, 100, 10**6]).collect()}
    assert cuts == {c: (sum(min(n, c) for n in lengths), sum(n > c for n in lengths)) for c in (0, 7, 100, 10**6)}
    for r in histogram.quantiles(found, [0.1, 0.5, 1.0]).collect():
        assert r.length == min(n for n in lengths if sum(m <= n for m in lengths) >= r.share * len(lengths))
    assert histogram.length_histogram(spark.createDataFrame([], "text string")).count() == 0


def filled(amount, children):
    """Shares of an amount among (weight, capacity) children, by bisection of the common rate."""
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, mid * w) for w, c in children) < amount else (low, mid)
    return [min(c, high * w) for w, c in children]


@pytest.mark.parametrize("share", [0.3, 1.0, 1.7, 9.0])
def test_budgets_pass_shortages_to_siblings_first(spark, share):
    rnd = random.Random(2)
    leaves = [(d, lang, f"s{k}", rnd.randrange(1, 2000), 5) for d in "ab" for lang in ("en", "de", None) for k in range(3)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint, n_docs bigint")
    weights = ({"a": 3, "b": 1}, {"en": 5, "de": 2}, {"s0": 4, "s2": 0})
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, *weights, share=share, max_epochs=2, otherwise=1).collect()}
    used = [x for x in leaves if x[2] != "s2"]
    tops = sorted({x[0] for x in used})
    cap = lambda *key: sum(2 * x[3] for x in used if x[: len(key)] == key)
    total = min(share * sum(x[3] for x in leaves), cap())
    for d, a in zip(tops, filled(total, [(weights[0][d], cap(d)) for d in tops])):
        langs = sorted({x[1] for x in used if x[0] == d}, key=str)
        for lang, b in zip(langs, filled(a, [(weights[1].get(x, 1), cap(d, x)) for x in langs])):
            own = [x for x in used if x[:2] == (d, lang)]
            for x, c in zip(own, filled(b, [(weights[2].get(x[2], 1), 2 * x[3]) for x in own])):
                assert got[x[:3]] == pytest.approx(c, rel=1e-6, abs=1e-4)
    assert set(got) == {x[:3] for x in used}


@pytest.mark.parametrize("per_bucket", [3, 10_000])
def test_mix_takes_prefixes_of_seeded_epochs(spark, per_bucket):
    rows, df = docs(spark)
    counted = mixing.counted(df).cache()
    plan = dict(domains={"web": 3, "other": 1}, languages={"en": 2}, sources={}, share=1.6, max_epochs=3)
    domain = F.when(F.col("source").isin("src1", "src2"), "web").otherwise("other")
    out = mixing.mix(counted, domain, docs_per_bucket=per_bucket, **plan).collect()
    leaves = counted.groupBy(domain.alias("domain"), "lang", "source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    budget = {(r.domain, r.lang, r.source): (r.budget, r.tokens) for r in mixing.budgets(leaves, **plan).collect()}
    everything = counted.withColumn("domain", domain)
    hashed = {e: everything.withColumn("h", F.xxhash64(F.lit(17), F.lit(e), "order_key")).collect() for e in range(4)}
    want = Counter()
    for leaf, (amount, tokens_here) in budget.items():
        for e in range(4):
            left, before = amount - e * tokens_here, 0
            for r in sorted((r for r in hashed[e] if (r.domain, r.lang, r.source) == leaf), key=lambda r: (r.h % 2**64, r.n_tokens)):
                if before < left - 1e-6:
                    want[(r.row.doc_id, r.row.text, e)] += 1
                before += r.n_tokens
    assert Counter((r.row.doc_id, r.row.text, r.epoch) for r in out) == want
    empty = mixing.mix(mixing.counted(df.limit(0)), domain, **plan)
    assert empty.count() == 0
