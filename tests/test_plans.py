"""Plan shape: what must stay native, pushed down and free of products."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
NATIVE = ["chain_verify", "read_wrap", "write_gate", "classify_durability", "flood_admission", "keywords_top20", "content_hash_dedup",
          "entity_mentions", "section_chunks", "paragraph_chunks", "decay_report"]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", NATIVE)
def test_native(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["knn_exact", "knn_self", "trust_conflicts", "entity_graph", "integrity_report", "tiered_recall"])
def test_no_products(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_is_pruned(spark):
    text = plan(contract.queries()["stale_procedural"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint>" in text
    text = plan(contract.queries()["repeat_conflicts"](spark, SF))
    assert "PushedFilters" in text and "ReadSchema: struct<ts:timestamp_ntz,event_type:string,props:string>" in text


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "query_id", "id", "rank", "memory_type", "effective_trust", "injection_flagged", "content_md5", "final_rank"]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_verify_shuffles_no_text(spark):
    """Texts are hashed at the scan; no exchange above it carries them."""
    from ledgerlake.operators import chain
    from tests.test_operators import KEYS, records

    stored = records(spark).withColumn("prev_hash", F.lit(None).cast("string")).withColumn("record_hash", F.lit("x"))
    text = plan(chain.verify(stored, KEYS))
    for block in text.split("\n\n"):
        if "Exchange" in block and "Input" in block:
            assert "content" not in block and "canonical" not in block


def test_a_text_is_screened_once(spark):
    """The flag was worked out again wherever it is read: for the flag, the override and the trust."""
    plan = contract.queries()["write_audit"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("disregard\\s") == 1


def test_pages_are_governed_once(spark):
    """Both sides of the join with the chain's hashes governed every page."""
    plan = contract.queries()["governed_writes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan


@pytest.mark.parametrize("name", ["jaccard_pairs", "trust_conflicts"])
def test_words_are_intersected_once(spark, name):
    """The overlap intersected the words of a pair at each use."""
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(old_words") + plan.count("array_intersect(new_words") == 1


def test_a_record_is_taken_apart_once(spark):
    """Each side of a pair split its text again."""
    plan = contract.queries()["jaccard_pairs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
