"""Spelling variants of frequent words, by pivotal bigrams.

Bigrams have one global order, rarest first. A word's prefix is its three rarest bigrams, with all
further places of the third. Of two words that one edit turns into each other, take the one whose
prefix ends earlier in the order: any two disjoint bigrams of it are hit by the edit at most once,
and the one that is left stands in the prefix of the other word, at the same place or moved by the
edit. So each word chooses two disjoint bigrams of its prefix, its pivots, as rare as possible (by
dynamic programming over places), and only pivots meet prefixes, under (bigram, place, length).
Whatever meets is verified in the join; nothing else leaves it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.scratch import drop, written

#: Maximal runs of letters, and the share of runs (one in) that lose a character.
RUN = "[A-Za-zÀ-ÿ]+"
SLIP = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
GRAM, PIVOTS = 2, 2
PREFIX = GRAM * (PIVOTS - 1) + 1
#: (difference of lengths, shift of places) that one edit can cause, seen from the pivots' word.
MOVES = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(df: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
            least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): the words of all whole texts that are long and frequent enough.

    Runs of letters, A-Z lower-cased. A run loses one character where the crc32 of key, colon and run
    divides by `slip` (0: never), as a stand-in for slips of the pen. Null texts have no runs; a null
    key is written as an empty one; repeated rows count each time. No words, no rows.
    """
    runs = df.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(f"`{text}`", F.lit(RUN), 0)).alias("raw")
    ).select("key", F.translate("raw", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if slip:
        hashed = runs.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs, word = hashed, F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def pivots(grams: list[tuple[int, int]], count: int = PIVOTS, gram: int = GRAM) -> list[int]:
    """Places of `count` disjoint grams of least total cost; grams are (place, cost), by place."""
    # best[t][i]: least cost, and the grams, of t disjoint ones among the first i.
    none = (float("inf"), ())
    best = [[(0, ())] * (len(grams) + 1)] + [[none] * (len(grams) + 1) for _ in range(count)]
    for i, (place, cost) in enumerate(grams, 1):
        before = next((j for j in range(i - 1, 0, -1) if grams[j - 1][0] <= place - gram), 0)
        for t in range(1, count + 1):
            total, chosen = best[t - 1][before]
            best[t][i] = min(best[t][i - 1], (total + cost, (*chosen, place)))
    return list(best[count][-1][1])


def indexed(words: DataFrame) -> DataFrame:
    """(word, n, len, last, prefix, pivots): prefix and pivots as structs of gram, as its rank, and place.

    The frequencies of bigrams are collected: at most the square of the alphabet, 8100 of 90 letters here.
    """
    letters = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.col("word").substr(k, F.lit(GRAM)))
    frequencies = words.select(F.explode(F.array_distinct(letters)).alias("gram")).groupBy("gram").count().collect()
    rank = {r.gram: (k, r["count"]) for k, r in enumerate(sorted(frequencies, key=lambda r: (r["count"], r.gram)))}

    def index(batches):
        for batch in batches:
            lasts, prefixes, chosen = [], [], []
            for word in batch.column(0).to_pylist():
                ranked = sorted((*rank[word[k : k + GRAM]], k) for k in range(len(word) - GRAM + 1))
                last = ranked[PREFIX - 1][0]
                prefix = {k: (r, cost) for r, cost, k in ranked if r <= last}
                own = pivots([(k, prefix[k][1]) for k in sorted(prefix)])
                lasts.append(last)
                prefixes.append([{"gram": r, "place": k} for k, (r, _) in prefix.items()])
                chosen.append([{"gram": prefix[k][0], "place": k} for k in own])
            kind = pa.list_(pa.struct([("gram", pa.int32()), ("place", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lasts, pa.int32()), pa.array(prefixes, kind), pa.array(chosen, kind)],
                names=[*batch.schema.names, "last", "prefix", "pivots"],
            )

    places = "array<struct<gram: int, place: int>>"
    return words.select("word", "n", F.length("word").alias("len")).mapInArrow(
        index, f"word string, n bigint, len int, last int, prefix {places}, pivots {places}"
    )


def near(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words that differ by one inserted, deleted or replaced character, once."""
    index = written(indexed(words))
    pivot = index.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("last").alias("last_a"), "len", F.explode("pivots").alias("p"))
    moves = F.array(*[F.struct(F.lit(d).alias("longer"), F.lit(s).alias("shift")) for d, s in MOVES])
    pivot = pivot.withColumn("m", F.explode(moves)).select(
        "a", "n_a", "last_a", F.col("p.gram").alias("gram"), (F.col("p.place") + F.col("m.shift")).alias("place"), (F.col("len") + F.col("m.longer")).alias("len")
    )
    prefix = index.select(
        F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("last").alias("last_b"), "len", F.explode("prefix").alias("p")
    ).select("b", "n_b", "last_b", F.col("p.gram").alias("gram"), F.col("p.place").alias("place"), "len")
    earlier = (F.col("last_a") < F.col("last_b")) | ((F.col("last_a") == F.col("last_b")) & (F.col("a") < F.col("b")))
    same = (pivot["gram"] == prefix["gram"]) & (pivot["place"] == prefix["place"]) & (pivot["len"] == prefix["len"])
    met = pivot.join(prefix, same & earlier & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    form is the near word of largest n, ties by code points, where that is at least `times` the word's
    n; root follows forms to the last one, or is the word itself. Counts of a repeated word are summed.
    Null words, and those of fewer than four characters, are left out; no words, no rows. Further
    columns are left out. Forms have larger counts, so following them ends; each step doubles its reach.
    """
    own = written(words.where(F.length("word") > PREFIX).groupBy("word").agg(F.sum("n").cast("bigint").alias("n")))
    pairs = written(near(own))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n"))
    )
    found = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best")
    )
    enough = -F.col("best.minus") >= times * F.col("n")
    table = written(
        own.join(found, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"),
            F.when(enough, -F.col("best.minus")).alias("form_n"),
        )
    )
    roots = _followed(table.where("form is not null").select("word", F.col("form").alias("root")))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _followed(links: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of links from every word; links form no circle."""
    links = written(links)
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(links)
        links, moved = step.select("word", "root"), step.where("moved").limit(1).count()
        if not moved:
            return links
