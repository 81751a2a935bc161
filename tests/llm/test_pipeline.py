"""The pipeline's stages against plain Python, and the registered queries on the smallest tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from ledgerlake.llm import cleaning, packing, queries, secrets
from tests.llm.test_simhash import brute_components, plain_fingerprint
from tests.llm.test_shingles import plain_groups
from tests.llm.test_texts import WORD, plain_base, plain_spans
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def documents(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice(["an", "the", "ti", "on", "ré"]) for _ in range(rnd.randrange(1, 4)))
    sentence = lambda: " ".join([word() for _ in range(rnd.randrange(6, 20))]).capitalize() + "."
    rows = []
    for k in range(120):
        lines = [sentence() for _ in range(rnd.randrange(2, 8))]
        if k % 6 == 0:
            lines.insert(1, "Home | About | News")
        if k % 7 == 0:
            lines.append(f"token = \"{rnd.getrandbits(160):040x}\"" + " and so on it goes.")
        if k % 11 == 0:
            lines = [x.upper().replace(" ", "!! ") + "!!" for x in lines]
        rows.append((k, "\n".join(lines), rnd.choice(["en", "de"]), f"src{k % 12}", 0, "more", 3))
    rows += [(200 + k, rows[k][1], "en", "src0", 0, "more", 3) for k in range(0, 60, 3)]
    rows += [(300, None, "en", "src1", 0, "m", 1), (301, "", "en", None, 0, "m", 2), rows[5], rows[5], (None, sentence() + " " + sentence(), "en", "src1", 0, "m", None)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int, kept string, domain int")


def plain_lines(text):
    """The failing rule of each line, by the rules as the docstrings state them."""
    out = []
    for line in text.split("\n"):
        words = WORD.findall(line)
        n = len(words)
        bad = n and (
            4 * sum(c in cleaning.SYMBOLS for c in line) > n or 4 * sum(w.endswith("!!") for w in words) > n
            or 4 * sum(a == b for a, b in zip(words, words[1:])) > n or (n <= 3 and not line.rstrip("\"'”’»)]").endswith(tuple(".!?:;…")))
            or any(p in line.lower() for p in cleaning.BOILERPLATE)
        )
        out.append((line, bool(bad), sum(map(len, words))))
    return out


def test_stages(spark):
    rows, docs = documents(spark)
    columns = docs.columns
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    want = Counter()
    for i, text, lang, source, _, *more in rows:
        if text is not None and not plain_base(text)[-1]:
            lines = plain_lines(text)
            if 100 * sum(n for _, bad, n in lines if bad) <= cleaning.LOST_PER_CENT * sum(n for *_, n in lines):
                clean = "\n".join(x for x, bad, _ in lines if not bad)
                want[(i, clean, lang, source, len(clean), *more)] += 1
    assert kept.columns == columns and Counter(map(tuple, kept.collect())) == want

    before = [tuple(r) for r in kept.collect()]
    single = corpus_pipeline.near_duplicates(spark, kept, SF)
    groups = plain_groups([r[1] for r in before])
    left = [tuple(r) for r in single.collect()]
    assert single.columns == columns and len(left) == len(set(groups)) and set(left) <= set(before)
    for g in set(groups):
        own = [before[k] for k in range(len(before)) if groups[k] == g]
        ids = [r[0] for r in own if r[0] is not None]
        assert [r[0] for r in left if r in own] == [min(ids) if ids else None]

    clean = corpus_pipeline.secret_scan(spark, single, SF)
    model = secrets.learn(single)
    got = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and len(got) == len(left)
    for r in left:
        found = plain_spans(r[1])
        assert (got[r[0]].text == r[1]) == (not model.spans(r[1], secrets.MARGIN)) and len(got[r[0]].text) == got[r[0]].n_chars
        assert not found or "[assign secret]" in got[r[0]].text
        assert not plain_spans(got[r[0]].text)

    mixed = corpus_pipeline.source_mix(spark, clean, SF)
    taken = Counter(tuple(r) for r in mixed.collect())
    assert mixed.columns == columns and set(taken) <= {tuple(r) for r in clean.collect()} and max(taken.values()) <= 4

    last = corpus_pipeline.best_fit_packing(spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in last if r.piece == 0) == Counter(r[0] for r in taken.elements())
    sizes = Counter()
    for r in last:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= queries.CONTEXT
    assert len(sizes) <= len(packing.best_fit(sorted((r.length for r in last), reverse=True), queries.CONTEXT)[2])
    assert len(sizes) >= math.ceil(sum(r.length for r in last) / queries.CONTEXT)


def test_empty_corpus(spark):
    _, docs = documents(spark)
    out = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        assert out.count() == 0


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found.count() > 0 and found.select("doc_id").subtract(docs.select("doc_id")).count() == 0


def test_all_eleven_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    assert compare(spark, SF, name, queries.QUERIES[name], queries.ORACLES[name])[1] == "ok"


def test_simhash_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    plain = [plain_fingerprint(r.text) for r in rows]
    groups = brute_components(plain, 4)
    least = {g: min(rows[k].doc_id for k in range(len(rows)) if groups[k] == g) for g in set(groups)}
    want = {(r.doc_id, f"{f:016x}", least[g]) for r, f, g in zip(rows, plain, groups)}
    assert {tuple(r) for r in queries.op10_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_quality_query_on_held_out_documents(spark):
    larger = "/root/testdata/sf0.01"
    out = queries.op8_quality_scores(spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) >= 0.95
