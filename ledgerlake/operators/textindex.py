"""A stored positional index: built once, searched many times.

Postings (stem, record, positions) lie in folders by a hash of the stem, so a search reads only the
folders of its own words and never the texts. A record meets a query through the words of one of
its groups; phrases and negations are judged on positions. Records that come later are appended.

The rank is the cover-density-free one of the published text search functions for weighted
positions, all of weight 0.1: for alternatives and lone words the sum over the query's words of
sum(1 / k^2) over their occurrences, divided by pi^2 / 6 and the number of words; for words that
are all required, and for phrases, 1 - product(1 - w) over pairs of occurrences of different words,
where w = 0.1 * sqrt(1 / (1.005 + 0.05 * exp(distance / 1.5 - 2))), or next to nothing beyond 100.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stem, stem_token
from ..functions.text import let
from ..session import cut_lineage
from .fulltext import TEXT_STOP_WORDS, parse_queries, words
from .ordering import first_n

BUCKETS = 64
_RECORDS_AT_ONCE, _STEMS_KEPT = 512, 500_000
# Fixed values of the rank: weight of a position, pi^2 / 6, the last position and the number of them that count.
WEIGHT, SQUARES, LAST_POSITION, POSITIONS = 0.1, 1.64493406685, 16_383, 256


def _bucket(stem: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(buckets)).cast("int")


def _stems(tokens: DataFrame, stemming: bool) -> DataFrame:
    """(token, stem) of distinct tokens."""
    distinct = tokens.select("token").distinct()
    return distinct.withColumn("stem", stem_token("token") if stemming else F.col("token"))


def _record_postings(entries: DataFrame, text: str, stemming: bool) -> DataFrame:
    """(stem, id, positions) of entries(id, text). A record's postings come from its own row, so nothing is shuffled."""
    stop = frozenset(TEXT_STOP_WORDS)
    forms: dict[str, str | None] = {}  # of a task

    def form(word: str) -> str | None:
        if word not in forms:
            if len(forms) >= _STEMS_KEPT:
                forms.clear()
            forms[word] = None if word in stop else stem(word) if stemming else word
        return forms[word]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _RECORDS_AT_ONCE):
                part = batch.slice(at, _RECORDS_AT_ONCE)
                lists = part.column(1)
                record = pc.list_parent_indices(lists).to_numpy()
                starts = np.searchsorted(record, np.arange(len(part)))
                words_ = lists.flatten().dictionary_encode()
                stems = pa.array([form(w) for w in words_.dictionary.to_pylist()], pa.string()).dictionary_encode()
                # Stop words have no code; several words can share one.
                code = stems.indices.fill_null(-1).to_numpy()[words_.indices.to_numpy()] if len(stems) else np.empty(0, np.int32)
                kept = np.flatnonzero(code >= 0)
                kept = kept[np.lexsort((kept, code[kept], record[kept]))]
                own, word = record[kept], code[kept]
                new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (word[1:] != word[:-1])][: len(kept)])
                places = pa.array((kept - starts[own] + 1).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [stems.dictionary.take(pa.array(word[new])), part.column(0).take(pa.array(own[new])),
                     pa.ListArray.from_arrays(pa.array(np.r_[new, len(kept)].astype(np.int32)), places)],
                    names=["stem", "id", "positions"],
                )

    id_type = entries.schema["id"].dataType.simpleString()
    listed = entries.select("id", words(F.col(text)).alias("words"))
    return listed.mapInArrow(run, f"stem string, id {id_type}, positions array<int>")


def add_to_index(entries: DataFrame, path: str, text: str = "content", stemming: bool = True, buckets: int = BUCKETS, batch_id: int = 0) -> None:
    """Write the postings of entries(id, text) under `path`; a batch written again takes its own place.

    Positions count all words from 1, stop words too, which have no postings. Null texts have none.
    A record belongs to one batch. `stemming` and `buckets` are the same for all batches of an index.
    """
    postings = _record_postings(entries, text, stemming).withColumn("bucket", _bucket(F.col("stem"), buckets))
    # The one shuffle of the texts. A bucket of a batch is a sorted run of files; a large one is spread over several.
    laid = postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "stem")
    laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch_id={batch_id}")
    entries.select("id").write.mode("overwrite").parquet(f"{path}/records/batch_id={batch_id}")
    spark = entries.sparkSession
    spark.createDataFrame([(stemming, buckets)], "stemming boolean, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def _plans(spark: SparkSession, path: str, queries: DataFrame) -> tuple[DataFrame, int]:
    """(query_id, groups, stems, all_required): the units of each query by group, as stems."""
    settings = spark.read.parquet(f"{path}/settings").first()
    parsed = cut_lineage(parse_queries(queries))
    keyed = parsed.join(_stems(parsed, settings.stemming), "token")
    units = keyed.groupBy("query_id", "grp", "unit", "negated").agg(F.sort_array(F.collect_list(F.struct("off", "stem"))).alias("words"))
    groups = units.groupBy("query_id", "grp").agg(F.collect_list(F.struct("negated", "words")).alias("units"))
    plans = groups.groupBy("query_id").agg(F.collect_list("units").alias("groups")).join(
        keyed.groupBy("query_id").agg(F.array_sort(F.collect_set("stem")).alias("stems")), "query_id"
    )
    only = F.col("groups")[0]
    required = (F.size("groups") == 1) & (F.size("stems") > 1) & ((F.size(only) > 1) | ~only[0]["negated"])
    return plans.withColumn("all_required", required), settings.buckets


def _times(at: Column, unit: Column) -> Column:
    """The record (stem to positions) has the unit."""
    first = unit["words"][0]
    phrase = F.exists(
        F.coalesce(at[first["stem"]], F.array().cast("array<int>")),
        lambda p: F.forall(unit["words"], lambda w: F.coalesce(F.array_contains(at[w["stem"]], (p - first["off"] + w["off"]).cast("int")), F.lit(False))),
    )
    return F.when(F.size(unit["words"]) == 1, at[first["stem"]].isNotNull()).otherwise(phrase)


def matches(groups: Column, at: Column) -> Column:
    """One group at least has all its units, and none of its negated ones."""
    return F.exists(groups, lambda units: F.forall(units, lambda u: _times(at, u) != u["negated"]))


def rank(stems: Column, at: Column, all_required: Column) -> Column:
    counted = F.transform(
        stems, lambda s: F.slice(F.array_distinct(F.transform(F.coalesce(at[s], F.array().cast("array<int>")), lambda p: F.least(p, F.lit(LAST_POSITION)))), 1, POSITIONS)
    )

    def lone(lists: Column) -> Column:
        total = F.aggregate(
            lists, F.lit(0.0),
            lambda acc, ps: acc + F.when(F.size(ps) == 0, 0.0).otherwise(
                F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ps), F.lit(1))), F.lit(0.0), lambda a, k: a + WEIGHT / (k.cast("double") * k))
            ),
        )
        return total / SQUARES / F.size(lists)

    def pair(one: Column, two: Column) -> Column:
        distance = F.abs(one - two)
        near = F.when(distance > 100, F.lit(1e-30)).otherwise(1.0 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2.0)))
        return F.when(distance == 0, F.lit(1.0)).otherwise(1.0 - WEIGHT * F.sqrt(near))

    def together(lists: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(lists))
        left = F.aggregate(
            places, F.lit(1.0),
            lambda acc, i: F.aggregate(
                places, acc,
                lambda acc2, k: F.when(k >= i, acc2).otherwise(
                    F.aggregate(F.element_at(lists, i), acc2, lambda a, p: F.aggregate(F.element_at(lists, k), a, lambda b, q: b * pair(p, q)))
                ),
            ),
        )
        return F.when(left == 1.0, F.lit(1e-20)).otherwise(1.0 - left)

    return let(counted, lambda lists: F.when(all_required, together(lists)).otherwise(lone(lists)))


def _leads(plans: DataFrame, postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, bucket, stem): the rarest word that each group requires; every word of a query with a group of negated units only."""
    asked = wanted.select("bucket", "stem").distinct()
    counts = postings.select("bucket", "stem").join(asked, ["bucket", "stem"]).groupBy("stem").count()
    groups = plans.select("query_id", "stems", F.posexplode("groups").alias("grp", "units"))
    needed = groups.withColumn(
        "needed", F.flatten(F.transform(F.filter("units", lambda u: ~u["negated"]), lambda u: F.transform(u["words"], lambda w: w["stem"])))
    )
    each = needed.filter(F.size("needed") > 0).select("query_id", "grp", F.explode("needed").alias("stem"))
    rarest = each.join(counts, "stem", "left").groupBy("query_id", "grp").agg(F.min_by("stem", F.struct(F.coalesce("count", F.lit(0)), "stem")).alias("stem"))
    every = needed.filter(F.size("needed") == 0).select("query_id", F.explode("stems").alias("stem"))
    return rarest.select("query_id", "stem").unionByName(every).distinct().join(wanted, ["query_id", "stem"])


def search_index(spark: SparkSession, path: str, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rank) of every record that matches one of queries(query_id, query), by the index alone.

    `allowed`(id) restricts the records. A query without words, or of stop words only, finds nothing; one
    of negated words only finds the other records, with a rank of next to nothing.
    """
    plans, buckets = _plans(spark, path, queries)
    plans = cut_lineage(plans)
    wanted = plans.select("query_id", F.explode("stems").alias("stem")).withColumn("bucket", _bucket(F.col("stem"), buckets))
    # The folders are known before the scan is planned: a list of at most `buckets` numbers.
    folders = [r.bucket for r in wanted.select("bucket").distinct().collect()]
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(*folders)) if folders else None
    records = spark.read.parquet(f"{path}/records").select("id")
    if allowed is not None:
        records = records.join(allowed.select("id"), "id", "left_semi")
    if postings is None:
        return records.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "id", F.lit(0.0).alias("rank")).limit(0)
    # A record meets a query through the rarest word of a group; only then its other postings are of use.
    leads = cut_lineage(_leads(plans, postings, wanted))
    led = postings.select("bucket", "stem", "id").join(leads, ["bucket", "stem"]).select("query_id", "id").distinct()
    if allowed is not None:
        led = led.join(allowed.select("id"), "id", "left_semi")
    led = cut_lineage(led)
    hits = postings.join(wanted, ["bucket", "stem"]).select("query_id", "id", "stem", "positions").join(led, ["query_id", "id"], "left_semi")
    # Cheap first: without positions, does the record have a word of each required unit of some group?
    # Rows of one id, should there be several, count as one record.
    once = hits.repartition("query_id", "id").groupBy("query_id", "id", "stem").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    met = once.groupBy("query_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("stem", "positions"))).alias("at"))
    judged = met.join(plans, "query_id").filter(matches(F.col("groups"), F.col("at")))
    found = judged.select("query_id", "id", rank(F.col("stems"), F.col("at"), F.col("all_required")).alias("rank"))
    free = plans.filter(F.exists("groups", lambda units: F.forall(units, lambda u: u["negated"])))
    if free.isEmpty():
        return found
    # Groups of negated units only also take records that have none of the query's words.
    rest = records.join(free.select("query_id"), F.lit(True)).join(met.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return found.unionByName(rest.select("query_id", "id", F.lit(1e-20).alias("rank")))


def ranked_search(spark: SparkSession, path: str, queries: DataFrame, entries: DataFrame, limit: int = 10) -> DataFrame:
    """The best entries of each query: by rank, then trust, then age, then id; `final_rank` from 1.

    Only the columns that order them are read before the cut; other columns join the few rows that are left.
    """
    keys = entries.select("id", "trust_score", "created_at")
    pool = search_index(spark, path, queries, allowed=keys).join(keys, "id")
    best = first_n(pool, ["query_id"], [F.round("rank", 9).desc(), F.col("trust_score").desc(), F.col("created_at").desc(), F.col("id")], limit, out="final_rank")
    return best.select("query_id", "id", "rank", "final_rank").join(entries, "id")
