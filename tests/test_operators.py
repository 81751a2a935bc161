"""Operators against brute force, with hot keys, ties and small blocks."""

import hashlib
import hmac
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import crypto
from ledgerlake.operators import chain, conflict, flood, fulltext, gates, graph, hooks, ingest, insights, knn, ordering, precedent, ranking, settling, state
from ledgerlake.schema import SERVER_OWNED_KEYS
from ledgerlake.streaming.inbox import self_conflicts

KEYS = {"k1": "one", "k2": "two"}


# --- ordering ---


def test_running_sum_splits_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", 5 if i % 2 else i, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, at int, id int")
    got = {r.id: r.position for r in ordering.running_sum(df, ["k"], ["at", "id"], partitions=6).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2])), 1):
            want[r[2]] = n
    assert got == want


def test_previous_value_over_buckets_and_gaps(spark):
    seqs = sorted(random.Random(1).sample(range(1, 5000), 300))
    df = spark.createDataFrame([("c", s, f"v{s}") for s in seqs], "c string, s bigint, v string")
    out = ordering.previous_value(df, ["c"], "s", "v", "p", bucket_rows=37).collect()
    want = {b: f"v{a}" for a, b in zip(seqs, seqs[1:])} | {seqs[0]: None}
    assert {r.s: r.p for r in out} == want


@pytest.mark.parametrize("slice_rows", [30, 10_000])
def test_greedy_select(spark, slice_rows):
    rnd = random.Random(7)
    takes = [(i, f"t{rnd.randrange(30) if i % 3 else 0}") for i in range(80) for _ in range(2)]
    needs = [(i, f"t{rnd.randrange(30)}") for i in range(80)]
    gone, want = set(), {}
    for i in range(80):
        want[i] = not any(t in gone for o, t in needs if o == i)
        if want[i]:
            gone |= {t for o, t in takes if o == i}
    df = settling.greedy_select(
        spark.range(80).select(F.col("id").alias("ord")),
        spark.createDataFrame(takes, "ord bigint, thing string"),
        spark.createDataFrame(needs, "ord bigint, thing string"),
        slice_rows=slice_rows,
    )
    assert {r.ord: r.accepted for r in df.collect()} == want


# --- flood ---


def brute_flood(rows, limit, window):
    out = {}
    for actor, us, i, low in rows:
        prior = sum(
            1 for a, u, j, l in rows
            if a == actor and l and (u, j) < (us, i) and u >= us - window * 1_000_000
        )
        out[i] = (prior, bool(low and prior >= limit))
    return out


def test_flood_hot_actor_and_ties(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 2 else f"a{i % 5}", rnd.randrange(40) * 30_000_000, i, i % 4 != 0) for i in range(400)]
    df = spark.createDataFrame(rows, "actor string, us bigint, id int, low boolean").withColumn("at", F.timestamp_micros("us"))
    out = flood.flood_admission(df, "actor", "at", "id", F.col("low"), 5, 300)
    assert {r.id: (r.prior, r.held) for r in out.collect()} == brute_flood(rows, 5, 300)
    off = flood.flood_admission(df, "actor", "at", "id", F.col("low"), 0, 300)
    assert off.filter("held").count() == 0


# --- chains ---


def records(spark, n=60):
    df = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.lit("c").alias("chain_id"), (F.col("id") + 1).alias("chain_seq"),
        F.when(F.col("id") % 2 == 0, "k1").otherwise("k2").alias("key_id"), F.concat(F.lit("text "), F.col("id")).alias("content"),
    )
    return df.withColumn("canonical", crypto.json_object({"content": crypto.json_string(F.col("content"))}))


def first_bad(df):
    r = chain.verify(df, KEYS).first()
    return r.chain_valid, r.records_checked, r.first_bad_record


def test_chain_is_one_walk(spark):
    linked = chain.append(records(spark), KEYS)
    rows = {r.chain_seq: r for r in linked.collect()}
    assert rows[1].prev_hash is None
    assert all(rows[i].prev_hash == rows[i - 1].record_hash for i in range(2, 61))
    assert first_bad(linked) == (True, 60, None)


def test_chain_tampering(spark):
    linked = chain.append(records(spark), KEYS)
    edited = linked.withColumn("canonical", F.when(F.col("id") == "7", "x").otherwise(F.col("canonical")))
    assert first_bad(edited) == (False, 60, "7")
    assert first_bad(linked.filter("id <> '7'")) == (False, 59, "8")
    swapped = linked.withColumn("chain_seq", F.expr("CASE id WHEN '3' THEN 5 WHEN '4' THEN 4 ELSE chain_seq END"))
    assert first_bad(swapped)[0] is False
    lost = chain.check_records(linked, {"k1": "one"})
    assert lost.filter("record_ok").count() == 30


def test_long_chain_is_one_walk(spark):
    """One chain of 120,000 records has the hashes of a plain walk, and verifies with defaults."""
    n = 120_000
    df = spark.range(n).select(
        "id", F.lit("c").alias("chain_id"), (F.col("id") + 1).alias("chain_seq"), F.lit("k1").alias("key_id"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("canonical"),
    )
    linked = chain.append(df.repartition(5), KEYS).cache()
    prev, want = "", {}
    for k in range(n):
        prev = hmac.new(KEYS["k1"].encode(), f"text {k}{prev}".encode(), hashlib.sha256).hexdigest()
        want[k] = prev
    got = linked.select("id", "record_hash").toPandas()
    assert dict(zip(got["id"], got["record_hash"])) == want
    assert first_bad(linked) == (True, n, None)
    linked.unpersist()


def test_chain_continues_from_heads(spark):
    whole = chain.append(records(spark), KEYS)
    part = whole.filter("chain_seq <= 25")
    heads = part.groupBy("chain_id").agg(F.max("chain_seq").alias("head_seq"), F.max_by("record_hash", "chain_seq").alias("head_hash"))
    rest = chain.append(records(spark).filter("chain_seq > 25"), KEYS, heads=heads)
    assert rest.select("id", "record_hash").exceptAll(whole.select("id", "record_hash")).count() == 0


# --- neighbours ---


def vectors(spark, n=240, d=6, seed=5):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n, d)).astype(np.float32)
    base[: n // 3] = base[0]  # a third are copies of one vector
    base[n // 3 : n // 2] += 0.0
    return base, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "id bigint, vector array<float>")


def brute_knn(base, k, limit=None):
    u = base.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = np.round(np.maximum(1 - u @ u.T, 0), 9)
    out = {}
    for i in range(len(u)):
        order = sorted((float(d[i, j]), j) for j in range(len(u)) if j != i and (limit is None or d[i, j] < limit))
        out[i] = [(j, x) for x, j in order[:k]]
    return out


@pytest.mark.parametrize("plan", [{}, {"scan_probes": 0, "pivots": 7, "block_rows": 16}, {"scan_probes": 0}])
@pytest.mark.parametrize("limit", [None, 0.2])
def test_self_nearest(spark, plan, limit):
    base, df = vectors(spark)
    got = {}
    for r in knn.self_nearest(df, 5, limit, **plan).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour_id, r.distance))
    want = brute_knn(base, 5, limit)
    for i, near in want.items():
        mine = [(n, d) for _, n, d in sorted(got.get(i, []))]
        assert [n for n, _ in mine] == [n for n, _ in near]
        assert [d for _, d in mine] == pytest.approx([d for _, d in near], abs=1e-8)


# --- full text ---

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, "Quick delivery of brown packages arrived today"),
    (3, "Unrelated database migration notes"),
    (4, "a fox, quick; a fox. Brown!"),
]


@pytest.mark.parametrize("units", [fulltext.MAX_BROADCAST_UNITS, -1])
@pytest.mark.parametrize(
    "query,want",
    [("quick brown", {1, 2, 4}), ("jumping fox", {1}), ('"brown fox"', {1}), ("zebra quick", set()), ("quick -fox", {2}),
     ("migrations or lazy", {1, 3}), ('quick -"brown fox"', {2, 4}), ("the", set()), ("-fox", {2, 3}),
     ("zebra or -fox", {2, 3}), ("-fox -quick", {3}), ("fox or -quick", {1, 3, 4}), ("-zebra", {1, 2, 3, 4})],
)
def test_match(spark, query, want, units):
    docs = spark.createDataFrame(DOCS, "id bigint, content string")
    q = spark.createDataFrame([(1, query)], "query_id bigint, query string")
    assert {r.id for r in fulltext.match(q, docs, max_broadcast_units=units).collect()} == want


def test_rank_counts_terms(spark):
    docs = spark.createDataFrame(DOCS, "id bigint, content string")
    q = spark.createDataFrame([(1, "fox"), (2, "fox or fox")], "query_id bigint, query string")
    rows = {(r.query_id, r.id): r["rank"] for r in fulltext.match(q, docs, False).collect()}
    assert rows[(1, 1)] == 0.5 and rows[(1, 4)] == pytest.approx(2 / 3, abs=1e-6) and rows[(2, 1)] == 1.0


# --- precedent ---


def fold_one(events):
    rule, seen, out = None, set(), []
    for seq, kind, res, src in events:
        if rule is None and kind == "reinforce":
            continue
        new = src not in seen
        if rule is None:
            rule = [res, 0.5, 1, seq]
        elif kind == "reinforce" or rule[0] == res:
            rule[1] = min(1.0, rule[1] + 0.1) if new else rule[1]
            rule[2] += 1
        elif rule[1] - 0.1 < 0.3:
            rule = [res, 0.5, 1, seq]
        else:
            rule[1] -= 0.1
        seen.add(src)
        out.append((seq, rule[0], rule[1], rule[2]))
    return rule, out


def deliberations(spark, n=900):
    rnd = random.Random(11)
    rows = []
    for seq in range(1, n + 1):
        p = "hot" if seq % 3 else f"p{seq % 4}"
        kind = "reinforce" if rnd.random() < 0.1 else "deliberate"
        res = rnd.choices(["a", "b", "c"], [0.5, 0.3, 0.2])[0]
        rows.append((p, seq, kind, res, "w" + res, f"s{rnd.randrange(40)}"))
    schema = "pattern_hash string, seq bigint, kind string, resolution string, winner_rule string, source_key string"
    return rows, spark.createDataFrame(rows, schema)


def test_precedent_fold_and_trace(spark):
    rows, df = deliberations(spark)
    folded = {r.pattern_hash: r for r in precedent.fold(df, chunk_rows=8).collect()}
    traced = {}
    for r in precedent.trace(df, chunk_rows=50).collect():
        traced.setdefault(r.pattern_hash, []).append((r.seq, r.after_resolution, r.confidence, r.applied_count))
    for p in {r[0] for r in rows}:
        rule, out = fold_one([(s, k, res, src) for q, s, k, res, _, src in rows if q == p])
        f = folded[p]
        assert (f.resolution, f.confidence, f.applied_count, f.winner_rule) == (rule[0], rule[1], rule[2], "w" + rule[0])
        assert sorted(traced[p]) == out


def test_precedent_fold_of_many_resolutions(spark):
    rows = [("p", i, "deliberate", f"r{i % 40:02d}", "w", f"s{i % 7}") for i in range(1, 201)]
    schema = "pattern_hash string, seq bigint, kind string, resolution string, winner_rule string, source_key string"
    f = precedent.fold(spark.createDataFrame(rows, schema), chunk_rows=16).first()
    rule, _ = fold_one([(s, k, res, src) for _, s, k, res, _, src in rows])
    assert (f.resolution, f.confidence, f.applied_count) == tuple(rule[:3])


def test_precedent_golden(spark):
    steps = [("a", "s1"), ("b", "s2"), ("b", "s3"), ("b", "s4"), ("b", "s4"), ("b", "s5")]
    df = spark.createDataFrame(
        [("p", i, "deliberate", r, r, s) for i, (r, s) in enumerate(steps, 1)],
        "pattern_hash string, seq bigint, kind string, resolution string, winner_rule string, source_key string",
    )
    rows = sorted(precedent.trace(df).collect(), key=lambda r: r.seq)
    assert [r.confidence for r in rows] == [0.5, 0.4, 0.30000000000000004, 0.5, 0.5, 0.6]
    assert [r.overturned for r in rows] == [False, False, False, True, False, False]


# --- gates ---


def results(spark):
    return spark.createDataFrame(
        [(1, "semantic", 0.9, "general", '{"tags":["a"]}'), (2, "transient", 0.9, "general", '{"tags":[]}'),
         (3, "semantic", 0.2, "code-sample", "{}"), (4, None, 0.9, "general", '{"tags":["b"]}'), (5, "semantic", 0.8, "general", '{"tags":["b"]}')],
        "id int, memory_type string, effective_trust double, content_class string, metadata string",
    )


@pytest.mark.parametrize(
    "rule,params,want",
    [("exclude_memory_type", {"memory_type": "transient"}, [1, 3, 5]), ("min_trust_floor", {"floor": 0.5}, [1, 2, 4, 5]),
     ("exclude_content_class", {"content_class": "general"}, [3]), ("exclude_tag", {"tag": "a"}, [2, 4, 5]),
     ("max_results", {"max_results": 2}, [1, 2]), ("max_results", {"max_results": 0}, []), ("max_results", {"max_results": True}, []),
     ("min_trust_floor", {"floor": 1.5}, []), ("mystery", {}, []), ("deny_write_memory_type", {"memory_type": "semantic"}, [1, 2, 3, 4, 5])],
)
def test_read_gate(spark, rule, params, want):
    out = gates.read_gate(results(spark), [gates.Rule(rule, params)], "me", [F.col("id")])
    assert sorted(r.id for r in out.collect()) == want


def test_read_gate_order_matters(spark):
    two = gates.Rule("max_results", {"max_results": 2})
    tag = gates.Rule("exclude_tag", {"tag": "a"})
    run = lambda rules: sorted(r.id for r in gates.read_gate(results(spark), rules, "me", [F.col("id")]).collect())
    assert run([two, tag]) == [2] and run([tag, two]) == [2, 4]


def test_write_gate_fails_closed(spark):
    df = spark.createDataFrame([("semantic", "general", 0.9, "agent-1"), ("identity", "general", 0.9, "agent-1")], "m string, c string, t double, a string")

    def run(*rules):
        g = gates.write_gate(F.col("m"), F.col("c"), F.col("t"), F.col("a"), list(rules))
        return [tuple(r) for r in df.select(g["deny_reason"], g["trust_score"]).collect()]

    assert run(gates.Rule("mystery", {}))[0][0] == "unknown rule type 'mystery'; write denied"
    assert run(gates.Rule("max_trust_for_content_class", {"content_class": "general", "max_trust": "x"}))[0][0].startswith("invalid")
    assert run(gates.Rule("mystery", {}, applies_to="other")) == [(None, 0.9), (None, 0.9)]
    cap = gates.Rule("max_trust_for_content_class", {"content_class": "general", "max_trust": 0.1})
    deny = gates.Rule("deny_write_memory_type", {"memory_type": "identity"}, "no")
    assert run(cap, deny) == [(None, 0.1), ("no", 0.1)]
    assert run(deny, cap) == [(None, 0.1), ("no", 0.9)]


# --- ingest, state, conflicts, clusters, graph, ranking ---


def test_admit_and_session(spark):
    df = spark.createDataFrame(
        [("see https://x.org", 0.9, "agent", None, '{"insight_type":"cluster","a":{"b":1}}'), ("plain", 0.5, None, "odd", "{}")],
        "content string, trust_score double, actor string, content_class string, metadata string",
    )
    a, b = ingest.admit(df).collect()
    assert (a.content_class, a.trust_score, a.class_ok) == ("external-untrusted", 0.6, True)
    assert a.metadata == '{"a":{"b":1},"declared_trust":0.9,"trust_clamped_to":0.6}'
    assert b.class_ok is False and b.metadata == "{}"
    assert len(SERVER_OWNED_KEYS) == 13
    ids = spark.createDataFrame([("{6BA7B811-9DAD-11D1-80B4-00C04FD430C8}",), ("nightly",), (None,)], "s string")
    s = ingest.split_session(F.col("s"))
    assert [tuple(r) for r in ids.select(s["session_id"], s["session_label"]).collect()] == [
        ("6ba7b811-9dad-11d1-80b4-00c04fd430c8", None), (None, "nightly"), (None, None)]


def test_retry_policy(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "n int")
    step = ingest.after_failure(F.lit("x"), F.col("n"), "held")
    assert [r[0] for r in df.select(step["status"]).collect()] == ["pending", "pending", "held"]


def test_state_requests(spark):
    entries = spark.createDataFrame([("a", None, None), ("b", datetime(2024, 1, 1), "z")], "id string, valid_until timestamp, superseded_by string")
    req = spark.createDataFrame(
        [(1, "superseded", "a", "n", "r", "me"), (2, "invalidated", "a", None, "r", "me"), (3, "redacted", "a", None, "r", "me"),
         (4, "invalidated", "b", None, "r", "me"), (5, "redacted", "b", None, "r", "me"), (6, "redacted", "x", None, "r", "me"), (7, "redacted", "b", None, " ", "me")],
        "seq int, event_type string, target_memory_id string, successor_memory_id string, reason string, actor string",
    )
    out = {r.seq: (r.reject_reason, r.successor_memory_id) for r in state.requested_events(req, entries).collect()}
    assert out == {1: (None, "n"), 2: ("already retired", None), 3: (None, "n"), 4: ("already retired", None), 5: (None, "z"),
                   6: ("record not found", None), 7: ("reason required", "z")}


def test_conflict_decisions(spark):
    rows = [
        ("n1", "o1", 1, 0, 1.0, 0.3, 1, "high"), ("n2", "o1", 1, 0, 0.9, 0.9, 2, "high"), ("n3", "o3", 1, 0, 0.85, 0.85, 3, "high"),
        ("n4", "o4", 1, 0, 0.95, 0.95, 4, "high"), ("n5", "o5", 1, 0, 0.3, 0.9, 5, "high"), ("n6", "o6", 1, 0, 0.3, 0.9, 6, "medium"),
    ]
    df = spark.createDataFrame(
        rows, "id string, neighbour_id string, rank int, flag_no int, new_trust_score double, old_trust_score double, new_chain_seq bigint, severity string"
    )
    for c in ("contradiction_type", "reason", "new_memory_type", "old_memory_type", "new_source_agent"):
        df = df.withColumn(c, F.lit("x"))
    out = {r.id: (r.loser_id, r.escalated, r.accepted, r.resolution) for r in conflict.settle(conflict.decide(df)).collect()}
    assert out == {
        "n1": ("o1", False, True, "trust_wins"), "n2": ("o1", True, False, "newer_wins"), "n3": ("o3", False, True, "newer_wins"),
        "n4": ("o4", True, True, "newer_wins"), "n5": ("n5", False, True, "trust_wins"),
    }


def test_same_text_different_trust(spark):
    e = spark.createDataFrame(
        [("a", "I like strong tea.", 1.0, 1), ("b", "I like strong tea.", 0.3, 2), ("c", "I hate strong tea.", 1.0, 3)], "id string, content string, trust_score double, chain_seq bigint"
    ).withColumn("memory_type", F.lit("semantic")).withColumn("source_agent", F.lit("s"))
    pairs = spark.createDataFrame([("b", "a", 1), ("c", "a", 1)], "id string, neighbour_id string, rank int")
    got = {(r.id, r.contradiction_type): (r.severity, r.reason) for r in conflict.flags(conflict.pair_up(pairs, e)).collect()}
    assert got[("b", "trust_conflict")] == ("high", "Trust delta 0.70 (old: 1.0, new: 0.3)")
    assert got[("c", "direct")] == ("high", "Prefer strong tea vs dislike strong tea")


def test_vectors_travel_by_block(spark):
    """A vector was sent to each cell that its bound leaves, which are nearly all where vectors have no structure."""
    vectors = np.random.default_rng(7).normal(size=(3_000, 24)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(vectors)), "vector": [[float(x) for x in v] for v in vectors]}), "id bigint, vector array<float>")
    store = spark.sparkContext._jsc.sc().statusStore()

    def sent():
        return sum(store.executorList(False).apply(k).totalShuffleWrite() for k in range(store.executorList(False).size()))

    before = sent()
    rows = knn.nearest(df.withColumnRenamed("id", "probe_id"), df, 3, scan_probes=0, pivots=100).orderBy("probe_id", "rank").collect()
    assert sent() - before < 10 * vectors.nbytes
    unit = knn._unit(list(vectors))
    far = np.round(np.maximum(1.0 - unit @ unit.T, 0.0), 9)
    want = [(p, int(i), r + 1) for p in range(len(far)) for r, i in enumerate(np.lexsort((np.arange(len(far)), far[p]))[:3])]
    assert [(r.probe_id, r.id, r["rank"]) for r in rows] == want


def test_words_are_fetched_for_open_pairs_only(spark, monkeypatch):
    """Every record's words were shuffled, once for each of its pairs; the flags are those of whole pairs."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rnd.sample(words, n)) for n in (10, 10, 20, 20, 20, 0)] + ["I like strong tea.", "I hate strong tea.", None]
    texts += [texts[2] + " more", texts[2], texts[3] + " and more words", texts[4].upper(), " " + texts[4], "I hate strong tea.  "]
    rows = [(k, t, 0.3 + 0.1 * (k * 5 % 8), k) for k, t in enumerate(texts)]
    e = spark.createDataFrame(rows, "id bigint, content string, trust_score double, chain_seq bigint").withColumn("memory_type", F.lit("semantic")).withColumn("source_agent", F.lit("s"))
    pairs = spark.createDataFrame([(a, b, 1) for a in range(len(rows)) for b in range(len(rows)) if a != b], "id bigint, neighbour_id bigint, rank int")
    written, cut = [], conflict.cut_lineage
    monkeypatch.setattr(conflict, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    for similarity, delta in ((0.7, 0.4), (0.5, 0.0), (0.0, 0.2), (-1.0, 0.4)):
        got, want = conflict.check(pairs, e, similarity, delta), conflict.flags(conflict.pair_up(pairs, e), similarity, delta)
        got = got.select(*want.columns)
        assert want.count() == got.count() > 0 and got.exceptAll(want).count() == 0
    words = next(df for df in written if "words" in df.columns)
    assert 0 < words.count() < len(rows) and 5 not in {r.id for r in words.collect()}


def test_records_far_apart_write_no_words(spark, monkeypatch):
    """Records of one trust and without preferences can't be in conflict, whatever their words."""
    rows = [(k, f"text number {k} of many", 0.5, k, None) for k in range(20)]
    e = spark.createDataFrame(rows, "id bigint, content string, trust_score double, chain_seq bigint, valid_until timestamp").withColumn("memory_type", F.lit("semantic")).withColumn("source_agent", F.lit("s"))
    written, cut = [], conflict.cut_lineage
    monkeypatch.setattr(conflict, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    assert self_conflicts(hooks.bag_embedder(64).apply(e)).count() == 0
    assert [df.count() for df in written if "words" in df.columns] == [0]


def test_clusters_walk(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(4, 8))
    vec = np.concatenate([c + 0.05 * rnd.normal(size=(6, 8)) for c in centres] + [rnd.normal(size=(3, 8))])
    start = datetime(2024, 1, 1)
    rows = [(i, f"text {i}", 0.3 + i / 100, [float(x) for x in v], start + timedelta(hours=i), None, "{}") for i, v in enumerate(vec)]
    df = spark.createDataFrame(rows, "id bigint, content string, trust_score double, embedding array<float>, created_at timestamp, valid_until timestamp, metadata string")
    out = {r.seed_id: r for r in insights.clusters(df, threshold=0.05).collect()}
    assert sorted(out) == [5, 11, 17, 23]
    assert sorted(out[5].members) == [0, 1, 2, 3, 4, 5] and out[5].trust_score == pytest.approx(0.3)
    assert out[23].content.startswith("Cluster: text 23 | ")


def test_graph_roundtrip(spark):
    docs = spark.createDataFrame(
        [(1, "Ann Lee works on Orbit with Python. Mail ann@mail.example.org"), (2, "Orbit uses Docker and python; see https://www.example.com/x"), (3, "Docker User left.")],
        "id bigint, content string",
    )
    men = graph.extract_entities(docs, {"Orbit": "project"})
    names = {(r.memory_id, r.name, r.entity_type) for r in men.collect()}
    assert (1, "Ann Lee", "person") in names and (2, "example.com", "organization") in names and (1, "mail.example.org", "organization") in names
    assert not any(t == "person" and m == 3 for m, _, t in names)
    rel = {(r.memory_id, r.subject, r.predicate, r.object) for r in graph.extract_relations(men).collect()}
    assert {(1, "Ann Lee", "works_on", "Orbit"), (1, "Ann Lee", "member_of", "mail.example.org"), (2, "Orbit", "uses", "Docker"), (2, "example.com", "develops", "Orbit")} <= rel


def test_relations_are_capped_in_order(spark):
    men = spark.createDataFrame(
        [(1, i, f"P{i:02d}", "person") for i in range(30)] + [(1, 30 + i, f"J{i:02d}", "project") for i in range(30)],
        "memory_id int, pos int, name string, entity_type string",
    )
    assert graph.extract_relations(men).count() == 900
    got = sorted((r.ord, r.subject, r.object) for r in graph.extract_relations(men, cap=20).collect())
    assert len(got) == 20 and got[0] == (0, "P00", "J00") and got[19] == (19, "P00", "J19")


def test_ranking(spark):
    assert ranking.pool_size(10, "fts") == 50 and ranking.pool_size(3, "fts") == 15 and ranking.pool_size(99, "semantic") == 99
    assert ranking.clamp_limit(500) == 500 and ranking.clamp_limit(500, 50) == 50 and ranking.clamp_limit(0) == 1
    score = lambda t, f: spark.range(1).select(ranking.safety_score(ranking.distance_relevance(F.lit(0.2)), F.lit(t), F.lit(f))).first()[0]
    assert score(0.6, False) == 0.64 and score(0.6, True) == 0.192


def test_summary_hook_falls_back(spark):
    from ledgerlake.operators import hooks

    found = spark.createDataFrame([(1, "Cluster: a"), (2, "Cluster: b")], "seed_id int, content string")
    told = hooks.summarise_clusters(found, lambda texts: ["short" if "a" in t[-1] else None for t in texts])
    assert sorted(r.content for r in told.collect()) == ["Cluster: b", "Insight: short"]

    def broken(texts):
        raise RuntimeError

    assert hooks.summarise_clusters(found, broken).filter("content LIKE 'Cluster%'").count() == 2


def test_entities_like_python(spark):
    """Whole pages against the same patterns in Python's re."""
    import re

    from ledgerlake.functions import text as tx

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(
        F.col("page_id").alias("id"), F.concat_ws("\n", "url", "html", F.lit("Dr. Ann Lee, Élan Vital and Python User")).alias("content")
    )
    want = set()
    for r in pages.collect():
        seen = set()
        known = {n.lower() for n in tx.GAZETTEER if re.search(rf"\b{re.escape(n)}\b", r.content, re.I)}
        for host in re.findall(tx.URL_HOST, r.content) + re.findall(tx.EMAIL_DOMAIN, r.content):
            seen.add((re.sub(r"^www\.", "", host.lower()), "organization"))
        for m in re.finditer(tx.PERSON, r.content):
            if m.group(1).lower() not in known and not any(t.lower() in known for t in m.group(1).split()):
                seen.add((m.group(1).lower(), "person"))
        for n, t in tx.GAZETTEER.items():
            if n.lower() in known:
                seen.add((n.lower(), t))
        want |= {(r.id, *x) for x in seen}
    got = {(r.memory_id, r.name.lower(), r.entity_type) for r in graph.extract_entities(pages).collect()}
    assert got == want and any(t == "person" for _, _, t in want)


def test_providers_see_texts_only(spark):
    rows = spark.createDataFrame([(1, "tea", 9), (2, None, 9)], "id int, content string, kept int")
    seen = hooks.Embedder("m", 2, lambda texts: [[len(t), 1.0] for t in texts], query_prefix="q:").apply(rows, as_query=True)
    assert [(r.id, r.kept, list(r.embedding), r.embedding_dimensions) for r in seen.orderBy("id").collect()] == [(1, 9, [5.0, 1.0], 2), (2, 9, [2.0, 1.0], 2)]
    want = [(b - 128) / 128 for b in hashlib.sha256(b"tea").digest()]
    got = hooks.hash_embedder(40).apply(rows.withColumn("content", F.upper("content"))).filter("id = 1").first().embedding
    assert list(got) == pytest.approx([want[i % 32] for i in range(40)])
    pairs = spark.createDataFrame([(1, 2, "a", "bcd")], "query_id int, id int, query string, content string")
    assert hooks.score_pairs(pairs, lambda qs, cs: [len(q) / len(c) for q, c in zip(qs, cs)]).first().score == pytest.approx(1 / 3)


def test_precedent_listing(spark):
    rows = [("b", 3, 0.5), ("a", 3, 0.5), ("c", 3, 0.9), ("d", 7, 0.3)]
    df = spark.createDataFrame(rows, "pattern_hash string, applied_count long, confidence double")
    assert [r.pattern_hash for r in precedent.listing(df).collect()] == ["d", "c", "a", "b"]


def test_neighbours_with_text_ids(spark):
    """Columns of texts came out of the two-sided plan in several chunks, which Spark refuses."""
    found = knn._best(
        np.array(["p", "q"], object), np.eye(2), np.array(["a", "b", "c"], object), np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]), 2, None, np.full(2, np.inf)
    )
    assert found["probe_id"].dtype == object and found["id"].dtype == object
    assert [tuple(r) for r in found[["probe_id", "id"]].itertuples(index=False)] == [("p", "a"), ("p", "c"), ("q", "b"), ("q", "a")]
    probes = spark.createDataFrame([(f"p{i}", [float(i % 7), 1.0]) for i in range(60)], "probe_id string, vector array<float>")
    got = knn.nearest(probes, probes.withColumnRenamed("probe_id", "id"), 1, scan_probes=0, pivots=3, block_rows=8).collect()
    assert {(r.probe_id, r.id) for r in got} == {(f"p{i}", min(f"p{j}" for j in range(i % 7, 60, 7))) for i in range(60)}


def test_loose_bounds_leave_few_pairs_to_measure():
    """A bound that rules nothing out left every pair of a block to be measured in double precision."""
    rng = np.random.default_rng(5)
    left, right = (knn._unit(rng.normal(size=(n, 8))) for n in (700, 5_000))
    row, column = knn._near_rows(left, right, 3, np.full(700, 2.0))
    assert len(row) < 700 * 5
    want = np.argsort(-(left @ right.T), axis=1)[:, :3]
    got = {(int(r), int(c)) for r, c in zip(row, column)}
    assert all((r, int(c)) in got for r in range(700) for c in want[r])


def test_a_vector_without_value_hides_no_other():
    """A row's largest product in a tile is NaN when one product is."""
    rng = np.random.default_rng(6)
    left, right = (knn._unit(rng.normal(size=(n, 8))) for n in (600, 3_000))
    alike = left @ right.T
    bound = 1.0 - np.sort(alike, axis=1)[:, -3]
    right[2_500] = np.nan
    row, column = knn._near_rows(left, right, 3, bound)
    got = {(int(r), int(c)) for r, c in zip(row, column)}
    assert all((r, c) in got for r in range(600) for c in np.argsort(-alike[r])[:3].tolist() if c != 2_500)


def test_words_are_stemmed_after_they_are_counted(spark):
    """The filter that a join on the stem brings was tested below the count, so each word of each text was stemmed."""
    entries = spark.createDataFrame([(1, "running runs ran")], "id int, content string")
    vocabulary = fulltext.build_vocabulary(entries)
    wanted = spark.createDataFrame([("run",)], "stem string")
    plan = wanted.join(vocabulary, "stem", "left")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    assert {r.token for r in wanted.join(vocabulary, "stem").collect()} == {"running", "runs"}


def test_chunk_maps_take_few_steps(monkeypatch):
    """A chunk was walked event by event with arrays of all states; pairs of maps are composed side by side instead."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({
        "seq": np.arange(10, 1_011), "res": rng.integers(0, 3, 1_001), "reinforce": rng.random(1_001) < 0.2, "is_new": rng.random(1_001) < 0.1,
    })
    nexts, starts, adds = precedent._tables(3)
    size = len(nexts[0])
    state, count, reset, seat = np.arange(size), np.zeros(size, int), np.zeros(size, bool), np.full(size, -1)
    for code, seq in zip(precedent._codes(rows, 3), rows["seq"]):
        start = starts[code][state]
        count = np.where(start, 1, count + adds[code][state])
        seat, reset, state = np.where(start, seq, seat), reset | start, nexts[code][state]
    steps, compose = [], precedent._compose
    monkeypatch.setattr(precedent, "_compose", lambda *maps: steps.append(1) or compose(*maps))
    for got, want in zip(precedent._fold(rows, 3), (state, count, reset, seat)):
        assert got.tolist() == want.tolist()
    assert 0 < len(steps) <= 10


def test_chunks_follow_rows_and_not_the_span_of_seq(spark):
    """Each span of `seq` was a chunk of its own, however few events of a pattern lay in it."""
    rows = [(p, i * 100 + p, "deliberate", "a" if i % 3 else "b", "w", "s") for p in range(2) for i in range(400)]
    rows += [(0, 50_000 + i, "deliberate", "b", "w", "t") for i in range(2, 90)]  # a dense stretch
    events = spark.createDataFrame(rows, "pattern_hash int, seq long, kind string, resolution string, winner_rule string, source_key string")
    ready, _ = precedent._prepared(events, 50)
    sizes = [r["count"] for r in ready.groupBy("pattern_hash", "chunk").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 100 and len(sizes) <= len(rows) // 50 + 2
    dense = {tuple(r) for r in precedent.trace(events, 10_000_000).collect()}
    assert {tuple(r) for r in precedent.trace(events, 50).collect()} == dense
