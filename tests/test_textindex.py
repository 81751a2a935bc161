"""The stored index against a plain walk over the texts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.stem import stem
from ledgerlake.operators import textindex
from ledgerlake.operators.fulltext import TEXT_STOP_WORDS

QUERIES = {
    1: "quick brown", 2: '"brown fox"', 3: "quick -fox", 4: "migrations or lazy", 5: '"lazy dogs" or zebra or "quick delivery"', 6: "fox", 7: "the", 8: "-fox", 9: "nothing here",
    10: '"fox quick" brown', 11: "brown brown packages", 12: '-"brown fox" quick', 13: "", 14: '"the quick"', 15: "fox or -quick",
}


def plain(text, query, stemming=True):
    """Rank of a text, or None: groups of units of (offset, stem)."""
    cut = stem if stemming else str
    at = {}
    for place, token in enumerate(re.findall(r"\w+", (text or "").lower()), 1):
        if token not in TEXT_STOP_WORDS:
            at.setdefault(cut(token), []).append(place)
    groups = []
    for part in re.split(r'(?i)\s+or\s+(?=(?:[^"]*"[^"]*")*[^"]*$)', query):
        units = []
        for unit in re.findall(r'-?"[^"]*"|\S+', part):
            named = [(k, cut(t)) for k, t in enumerate(re.findall(r"\w+", unit.lower())) if t not in TEXT_STOP_WORDS]
            if named:
                units.append((unit.startswith("-"), named))
        if units:
            groups.append(units)

    def has(named):
        return any(all(p - named[0][0] + k in at.get(s, ()) for k, s in named) for p in at.get(named[0][1], ()))

    if not any(all(has(named) != negated for negated, named in units) for units in groups):
        return None
    stems = sorted({s for units in groups for _, named in units for _, s in named})
    lists = [sorted({min(p, 16_383) for p in at.get(s, ())})[:256] for s in stems]
    if len(groups) == 1 and len(stems) > 1 and (len(groups[0]) > 1 or not groups[0][0][0]):
        rest = 1.0
        for i in range(len(lists)):
            for k in range(i):
                for p in lists[i]:
                    for q in lists[k]:
                        d = abs(p - q)
                        if d:
                            rest *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
        return 1e-20 if rest == 1.0 else 1 - rest
    score = sum(0.1 / k**2 for ps in lists for k in range(1, len(ps) + 1)) / 1.64493406685 / len(lists)
    return score if any(lists) else 1e-20


def docs():
    rnd = random.Random(4)
    out = {1: "The quick brown fox jumps over the lazy dog", 2: "Quick delivery of brown packages arrived today", 3: "Unrelated database migration notes",
           4: "a fox, quick; a fox. Brown!", 5: None, 6: "", 7: "fox " * 300, 8: "x " * 20_000 + "quick brown"}
    pool = "quick brown fox lazy dogs the migration packages package delivery zebra of notes".split()
    for k in range(9, 60):
        out[k] = " ".join(rnd.choice(pool) for _ in range(rnd.randrange(2, 40)))
    return out


@pytest.mark.parametrize("stemming", [True, False])
def test_same_as_a_plain_walk(spark, tmp_path, stemming):
    texts, path = docs(), str(tmp_path)
    df = spark.createDataFrame(list(texts.items()), "id bigint, content string")
    textindex.add_to_index(df.filter("id < 20"), path, stemming=stemming, buckets=8, batch_id=0)
    textindex.add_to_index(df.filter("id >= 20"), path, stemming=stemming, buckets=8, batch_id=1)
    textindex.add_to_index(df.filter("id >= 20"), path, stemming=stemming, buckets=8, batch_id=1)  # again: nothing doubles
    asked = spark.createDataFrame(list(QUERIES.items()), "query_id int, query string")
    got = {(r.query_id, r.id): r["rank"] for r in textindex.search_index(spark, path, asked).collect()}
    want = {(q, i): score for q, query in QUERIES.items() for i, text in texts.items() if (score := plain(text, query, stemming)) is not None}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-18) for k in want)


def test_best_first_and_scope(spark, tmp_path):
    texts, path = docs(), str(tmp_path)
    df = spark.createDataFrame([(i, t, 0.5 + (i % 3) / 10, i) for i, t in texts.items()], "id bigint, content string, trust_score double, at bigint").withColumn(
        "created_at", F.timestamp_seconds("at"))
    textindex.add_to_index(df, path)
    asked = spark.createDataFrame([(1, "quick brown"), (2, "fox")], "query_id int, query string")
    allowed = df.filter("id % 2 = 0")
    got = textindex.ranked_search(spark, path, asked, allowed, 5).collect()
    for q, query in ((1, "quick brown"), (2, "fox")):
        found = [(-round(s, 9), -(0.5 + (i % 3) / 10), -i, i) for i, t in texts.items() if i % 2 == 0 and (s := plain(t, query)) is not None]
        assert [r.id for r in sorted(got, key=lambda r: r.final_rank) if r.query_id == q] == [i for *_, i in sorted(found)[:5]]


def test_a_search_reads_only_its_own_folders(spark, tmp_path):
    path = str(tmp_path)
    textindex.add_to_index(spark.createDataFrame(list(docs().items()), "id bigint, content string"), path)
    found = textindex.search_index(spark, path, spark.createDataFrame([(1, "zebra")], "query_id int, query string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "content" not in plan


def _exchanges(spark, work):
    """Rows that the stages of `work()` shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    more = [getattr(store, f"stageList$default${i}")() for i in range(2, 6)]
    listed = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    seen = {s.stageId() for s in listed(store.stageList(None, *more))}
    work()
    return sum(s.shuffleWriteRecords() for s in listed(store.stageList(None, *more)) if s.stageId() not in seen)


def test_building_shuffles_each_posting_once(spark, tmp_path):
    """Words were shuffled by record, by word, by stem and by range before they were written."""
    rows = [(i, " ".join(f"word{(i * 7 + k) % 50} common" for k in range(20))) for i in range(200)]
    entries = spark.createDataFrame(rows, "id long, content string")
    moved = _exchanges(spark, lambda: textindex.add_to_index(entries, str(tmp_path)))
    postings = spark.read.parquet(f"{tmp_path}/postings").count()
    assert postings == 200 * 21 and moved == postings


def test_a_common_word_meets_only_records_with_the_rarest(spark, tmp_path):
    rows = [(i, "common words " + ("rare" if i % 50 == 0 else "usual")) for i in range(1_000)] + [(5_000, None), (5_001, "")]
    textindex.add_to_index(spark.createDataFrame(rows, "id long, content string"), str(tmp_path), stemming=False)
    queries = spark.createDataFrame([(1, "common words rare"), (2, "-common"), (3, "missing common or rare -usual")], "query_id int, query string")
    found = textindex.search_index(spark, str(tmp_path), queries)
    required = queries.filter("query_id <> 2")
    moved = _exchanges(spark, lambda: textindex.search_index(spark, str(tmp_path), required).write.format("noop").mode("overwrite").save())
    assert moved < 1_000
    got = {q: {r.id for r in found.filter(F.col("query_id") == q).collect()} for q in (1, 2, 3)}
    rare = set(range(0, 1_000, 50))
    assert got == {1: rare, 2: {5_000, 5_001}, 3: rare}


def test_rows_of_one_id_are_one_record(spark, tmp_path):
    rows = [(1, "alpha beta"), (1, "alpha gamma"), (2, "alpha")]
    textindex.add_to_index(spark.createDataFrame(rows, "id long, content string"), str(tmp_path), stemming=False)
    queries = spark.createDataFrame([(1, "beta gamma")], "query_id int, query string")
    assert {r.id for r in textindex.search_index(spark, str(tmp_path), queries).collect()} == {1}
