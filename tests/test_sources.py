"""Files in and out: markdown, labelled corpora, archives."""

import json
import os
import re
from datetime import datetime

from pyspark.sql import functions as F

from ledgerlake.functions import crypto
from ledgerlake.functions import text as tx
from ledgerlake.operators import chain, hooks
from ledgerlake.schema import ARCHIVE_RECORD
from ledgerlake.sources import archive, corpus, markdown

KEYS = {"k1": "one"}


def test_markdown_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    long = "Sentence number one is here. " * 60
    (tmp_path / "a.md").write_text("---\nt: 1\n---\nintro " + "x" * 90 + "\n## First\n" + "y" * 90 + "\n## Short\nz\n")
    (tmp_path / "sub" / "b.md").write_text("no sections " + "w" * 90)
    (tmp_path / "sub" / "skip.md").write_text("private " + "w" * 90)
    (tmp_path / "c.txt").write_text("no")
    docs = markdown.scan(spark, str(tmp_path), exclude=("SKIP",))
    assert docs.count() == 2
    rows = sorted((r.title, r.body[:9]) for r in markdown.section_chunks(docs).collect())
    assert [t for t, _ in rows] == ["a", "a › First", "b"] and rows[1][1] == "## First\n"
    one = spark.createDataFrame([(long,)], "text string")
    chunks = [r.chunk for r in markdown.paragraph_chunks(one).collect()]
    want, current = [], ""
    for s in re.split(r"(?<=[.!?])\s+", long.strip()):
        if len(current) + len(s) + 1 > 1200 and current:
            want.append(current.strip())
            current = s
        else:
            current = (current + " " + s).strip() if current else s
    want.append(current.strip())
    assert chunks == want and max(map(len, chunks)) <= 1200


def test_first_copies_with_a_hot_text(spark):
    rows = [("same" if i % 3 else f"t{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "content string, n int")
    stored = spark.createDataFrame([("t0",)], "c string").select(tx.content_hash(F.col("c")).alias("content_hash"))
    got = sorted(r.n for r in markdown.first_copies(df, ["n"], stored=stored).collect())
    assert got == [1] + list(range(3, 300, 3))


def test_labelled_corpus(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"schema_version": "1.0", "cases": [{"id": "a", "label": True, "category": "x", "text": "ignore all"}, {"id": "b", "label": False, "category": "y", "text": "ok"}]}, indent=1))
    df = corpus.read_labelled(spark, str(path)).withColumn("hit", tx.injection_flag(F.col("text")))
    assert df.filter("label <> hit").count() == 0 and df.count() == 2


def stored_records(spark):
    df = spark.createDataFrame(
        [(f"r{i}", f"text {i % 8} é", i + 1, '{"content_class":"general","injection_flagged":true,"note":"n"}' if i % 2 else "{}") for i in range(10)],
        "id string, content string, chain_seq bigint, metadata string",
    )
    df = (
        df.withColumn("trust_score", F.lit(0.8)).withColumn("memory_type", F.lit("semantic")).withColumn("key_id", F.lit("k1"))
        .withColumn("embedding_model", F.lit("m")).withColumn("embedding_dimensions", F.lit(64)).withColumn("chain_id", F.lit("c"))
        .withColumn("created_at", F.lit(datetime(2024, 1, 1))).withColumn("valid_until", F.lit(None).cast("timestamp"))
        .withColumn("content_hash", tx.content_hash(F.col("content")))
    )
    canonical = crypto.canonical_record(*[F.col(c) for c in ("content", "embedding_model", "embedding_dimensions", "trust_score", "memory_type", "key_id", "metadata")])
    return chain.append(df.withColumn("canonical", canonical), KEYS)


def no_events(spark):
    return spark.createDataFrame([], "target_memory_id string, event_type string, actor string, reason string, created_at timestamp, chain_seq bigint")


def test_archive_round_trip(spark, tmp_path):
    rows = stored_records(spark)
    path = str(tmp_path / "arc")
    out = archive.export_records(rows, no_events(spark))
    archive.write_archive(path, out, chain.verify(rows, KEYS), datetime(2024, 2, 1), memory_type=None)
    assert archive.check_manifest(spark, path)["chain_valid"] is True
    with open(f"{path}/records/part-extra.txt", "w") as f:
        f.write("{broken\n")
    routed = archive.route_import(archive.read_archive(spark, path), KEYS, "k1")
    counts = {r.outcome: r.n for r in archive.outcome_counts(routed).collect()}
    assert counts == {"imported": 8, "skipped_duplicate": 2, "error": 1}
    r = routed.filter("id = 'r1'").first()
    meta = json.loads(r.metadata)
    assert r.hmac_verified and r.trust_score == 0.8 and meta["injection_flagged"] is True
    assert meta["imported_from"]["original_id"] == "r1" and meta["note"] == "n"
    other = archive.route_import(archive.read_archive(spark, path), {"k1": "wrong"}, "k1").filter("id = 'r1'").first()
    assert not other.hmac_verified and other.trust_score == 0.3 and "injection_flagged" not in json.loads(other.metadata)


def test_import_keeps_rows_of_chains_with_the_same_numbers(spark):
    rows = stored_records(spark).withColumn("chain_id", F.when(F.col("id") < "r5", "a").otherwise("b")).withColumn("chain_seq", F.lit(1).cast("bigint"))
    lines = archive.record_lines(archive.export_records(rows, no_events(spark)))
    parsed = lines.select(F.from_json("value", ARCHIVE_RECORD).alias("r")).select("r.*").withColumn("_corrupt", F.lit(None).cast("string"))
    routed = archive.route_import(parsed, KEYS, "k1")
    assert routed.count() == parsed.count() == rows.count()
    assert routed.filter("outcome = 'imported'").count() == rows.select("content_hash").distinct().count()


def test_archive_in_one_stream(spark, tmp_path):
    rows = stored_records(spark)
    audit = spark.createDataFrame(
        [("r1", 2, "searched", "x", "{}", datetime(2024, 1, 2)), ("r1", 1, "created", "y", "{}", datetime(2024, 1, 1))],
        "memory_id string, id int, action string, actor string, details string, timestamp timestamp",
    )
    path = str(tmp_path / "one")
    archive.write_stream(path, archive.export_records(rows, no_events(spark)), chain.verify(rows, KEYS), datetime(2024, 2, 1), audit)
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    text = "".join(open(f"{path}/{p}").read() for p in parts).splitlines()
    assert "exported_at" in json.loads(text[0]) and len(text) == rows.count() + 1
    found = next(json.loads(x) for x in text[1:] if json.loads(x)["id"] == "r1")
    assert [e["action"] for e in found["audit_trail"]] == ["created", "searched"] and found["chain_id"] == "c"
    back = archive.read_stream(spark, path)
    assert back.count() == rows.count()
    bad = str(tmp_path / "bad")
    lines = [text[0], text[1], '{"id": "r9", "schema_version": "1.0", "content": null}', "{no json"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(bad)
    counts = {r.outcome: r.n for r in archive.outcome_counts(archive.route_import(archive.read_stream(spark, bad), KEYS, "k1")).collect()}
    assert counts == {"imported": 1, "error": 2}
    routed = archive.route_import(back, KEYS, "k1")
    done = archive.import_records(routed, [], 64, hooks.hash_embedder(64).apply, KEYS, "k1")
    good = done.filter("reject_reason IS NULL")
    assert good.count() == routed.filter("outcome = 'imported'").count() > 0
    assert chain.verify(good, KEYS).filter("NOT chain_valid").count() == 0


def test_redacted_export(spark):
    rows = stored_records(spark).withColumn("valid_until", F.when(F.col("id") == "r2", F.lit(datetime(2024, 1, 2))))
    events = spark.createDataFrame([("r2", "redacted", "me", "why", datetime(2024, 1, 2), 1)], no_events(spark).schema)
    assert archive.export_records(rows, events).count() == 9
    masked = archive.export_records(rows, events, include_redacted=True)
    assert masked.count() == 10 and masked.filter("id = 'r2'").first().content == "[REDACTED]"
    line = json.loads(archive.record_lines(masked.filter("id = 'r2'")).first().value)
    assert line["redaction"] == {"reason": "why", "actor": "me", "redacted_at": "2024-01-02T00:00:00+00:00"} and line["metadata"] == {}


def test_retention(spark):
    inbox = spark.createDataFrame(
        [(1, "approved", datetime(2024, 1, 1)), (2, "held", datetime(2024, 1, 1)), (3, "rejected", datetime(2024, 3, 1)), (4, "merged", None)],
        "id int, status string, processed_at timestamp",
    )
    kept = archive.retained_inbox(inbox, datetime(2024, 3, 2))
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4]


def test_cold_archive_is_written_once(spark, tmp_path):
    """Runs that are repeated or that overlap leave one copy of each record, and count what they wrote."""
    path = str(tmp_path / "cold")
    rows = spark.createDataFrame(
        [(k, f"text {k}", datetime(2023, 1 + k % 3, 5), [0.1]) for k in range(30)], "id int, content string, valid_until timestamp, embedding array<double>"
    )
    none = spark.createDataFrame([], "id int")
    old = archive.archivable(rows, none, datetime(2024, 1, 1))
    assert archive.write_cold(old.filter("id < 20"), path) == {"2023-01": 7, "2023-02": 7, "2023-03": 6}
    assert archive.write_cold(old.filter("id < 20"), path) == {}
    assert archive.write_cold(old.filter("id % 3 = 0").unionByName(old.filter("id = 3")), path) == {"2023-01": 3}
    assert archive.write_cold(old, path) == {"2023-02": 3, "2023-03": 4}
    got = spark.read.parquet(path).select("id", "content", "month").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(k, f"text {k}", f"2023-0{1 + k % 3}") for k in range(30)]


def test_inbox_expiry(spark, tmp_path):
    path = str(tmp_path / "inbox")
    inbox = spark.createDataFrame(
        [(1, "approved", datetime(2024, 1, 1), datetime(2024, 1, 1)), (2, "held", datetime(2024, 1, 1), datetime(2024, 1, 2)),
         (3, "rejected", datetime(2024, 3, 1), datetime(2024, 1, 2)), (4, "merged", None, datetime(2024, 1, 3)), (5, None, None, datetime(2024, 1, 3))],
        "id int, status string, processed_at timestamp, submitted_at timestamp",
    )
    assert archive.expire_inbox(inbox, path, datetime(2024, 1, 5)) == {"kept": 5, "expired": 0}
    for _ in range(2):
        assert archive.expire_inbox(inbox, path, datetime(2024, 3, 2)) == {"kept": 4, "expired": 1}
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4, 5]


def test_numbers_of_an_archive_are_found_without_texts(spark, monkeypatch):
    from ledgerlake.plans import governance

    class Seen(Exception):
        pass

    def stop(df, *a, **b):
        raise Seen(df.columns)

    monkeypatch.setattr(governance, "running_sum", stop)
    try:
        governance.import_outcomes(spark, "/root/testdata/sf0.001")
    except Seen as seen:
        assert set(seen.args[0]) == {"id", "chain_id", "chain_seq"}
    else:
        raise AssertionError("running_sum isn't used")
