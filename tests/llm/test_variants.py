"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import queries, variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts):
    near = {w: [o for o in counts if o != w and one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best and counts[best] >= 5 * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def plain_counts(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_query(spark, tmp_path):
    rnd = random.Random(2)
    stems = ["straße", "garden", "gardens", "gärden", "École", "kitten", "mitten", "aaaaaa", "aaaaaaa", "aaaaaaaa", "banana", "bananas"]
    docs = []
    for k in range(400):
        words = [rnd.choice(stems[: 1 + rnd.randrange(len(stems))]) for _ in range(60)]
        docs.append((k if k % 50 else None, rnd.choice([" ", ", ", "1", "_"]).join(w.upper() if rnd.random() < 0.2 else w for w in words)))
    docs += [(7, docs[7][1]), (7, docs[7][1]), (1000, None), (1001, ""), (1002, "x" * 50_000), (1003, "zyxwvu " * 3000)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_spelling_variants(spark, str(tmp_path))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(plain_counts(docs))
    assert {tuple(r) for r in out.collect()} == want
    assert any(w[1] for w in want) and any(w[4] > 2 for w in want)


def test_chains_and_ties(spark):
    counts = {"garden": 10_000, "gardens": 2_000, "gardxns": 400, "gaxdxns": 80, "gaxdxnsq": 16, "garten": 10_000, "galden": 3,
              "zzzzzz": 5, "zzzzzzz": 25, "zzzzzzzz": 125, "äzzzzz": 5, "lonely": 9}
    rows = [(w, n - 1, "c") for w, n in counts.items()] + [(w, 1, "c") for w in counts] + [(None, 4, "c"), ("abc", 9, "c")]
    got = variants.variants(spark.createDataFrame(rows, "word string, n bigint, `form` string")).collect()
    assert {tuple(r) for r in got} == plain(counts)
    assert {r.word: r.root for r in got}["gaxdxnsq"] == "garden"


def test_empty(spark):
    assert variants.variants(spark.createDataFrame([], "word string, n bigint")).count() == 0
    assert variants.counted(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_all_words_over_a_small_alphabet(spark):
    words = {"".join(w): k % 97 + 1 for k, w in enumerate(itertools.product("abc", repeat=5))}
    words |= {"".join(w): k % 31 + 1 for k, w in enumerate(itertools.product("ab", repeat=6))}
    got = variants.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()
    assert {tuple(r) for r in got} == plain(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=3, max_size=9))
def test_pivots_are_the_cheapest(costs):
    grams = list(enumerate(costs))
    own = variants.pivots(grams)
    assert len(own) == 2 and own[1] - own[0] >= 2
    assert sum(costs[k] for k in own) == min(costs[a] + costs[b] for a in range(len(costs)) for b in range(a + 2, len(costs)))
