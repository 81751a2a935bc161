"""Full-text match of a whole table of queries.

Queries take four forms: words (all required), "phrases", -negated units and `or` between
groups. Each query group is driven by its rarest required word: a record meets a query only
through that word, and the other words are checked in the row, so no posting list is shuffled. A
group of negated units only is driven by a mark that every record has; its result is all records
but those that it names, so the work is that of writing it, and its rank is 0.
rank = sum over the matched units of tf / (tf + 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem_token
from ..functions.text import cased, let
from ..session import cut_lineage

# English words the text configuration ignores.
TEXT_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself"
    " she her hers herself it its itself they them their theirs themselves what which who whom"
    " this that these those am is are was were be been being have has had having do does did"
    " doing a an the and but if or because as until while of at by for with about against"
    " between into through during before after above below to from up down in out on off over"
    " under again further then once here there when where why how all any both each few more"
    " most other some such no nor not only own same so than too very s t can will just don"
    " should now"
).split()

MAX_BROADCAST_UNITS = 200_000
ANY_RECORD = ""  # no word is empty
_OUTSIDE_QUOTES = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(cased(r"(\w+)")), F.lit(1))


def parse_queries(queries: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, grp, unit, negated, off, token): one row per word of each query unit."""
    groups = queries.select(
        "query_id",
        F.posexplode(F.split(F.col(text), r"(?i)\s+or\s+" + _OUTSIDE_QUOTES)).alias("grp", "gtext"),
    )
    units = groups.select(
        "query_id",
        "grp",
        F.posexplode(
            F.regexp_extract_all("gtext", F.lit(r'(-?"[^"]*"|\S+)'), F.lit(1))
        ).alias("unit", "utext"),
    )
    return units.select(
        "query_id",
        "grp",
        "unit",
        F.col("utext").startswith("-").alias("negated"),
        F.posexplode(words(F.col("utext"))).alias("off", "token"),
    ).filter(~F.col("token").isin(*TEXT_STOP_WORDS))


def build_vocabulary(entries: DataFrame, text: str = "content", stemming: bool = True) -> DataFrame:
    """(token, stem, cf): distinct words with their corpus counts. Worth storing once."""
    counted = (
        entries.select(F.explode(words(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("cf"))
    )
    # Written: a join on the stem would else be tested below the count, which stems every word of every text.
    return cut_lineage(counted).withColumn("stem", stem_token("token")) if stemming else counted.withColumn("stem", F.col("token"))


def _query_table(terms: DataFrame, vocabulary: DataFrame, stemming: bool) -> DataFrame:
    """(query_id, groups, drivers): units with the spellings of every word, the required words
    of one spelling (a cheap set test), and the spellings of the rarest word of each group."""
    keyed = terms.withColumn("stem", stem_token("token") if stemming else F.col("token"))
    # Written once: the vocabulary is a pass over the corpus, and three tables below need it.
    per_word = cut_lineage(
        keyed.join(vocabulary.withColumnRenamed("token", "form"), "stem", "left")
        .groupBy("query_id", "grp", "unit", "negated", "off")
        .agg(F.collect_list("form").alias("forms"), F.coalesce(F.sum("cf"), F.lit(0)).alias("cf"))
    )
    units = per_word.groupBy("query_id", "grp", "unit", "negated").agg(
        F.sort_array(F.collect_list(F.struct("off", "forms"))).alias("words")
    )
    drivers = (
        per_word.filter("NOT negated")
        .groupBy("query_id", "grp")
        .agg(F.min_by("forms", F.struct("cf", "unit", "off")).alias("driver"))
    )
    lone = F.when(~F.col("negated") & (F.size("forms") == 1), F.col("forms")[0])
    musts = per_word.groupBy("query_id", "grp").agg(F.collect_set(lone).alias("must"))
    groups = units.groupBy("query_id", "grp").agg(
        F.collect_list(F.struct("negated", "words")).alias("units")
    )
    return (
        groups.join(drivers, ["query_id", "grp"], "left")
        .withColumn("driver", F.coalesce("driver", F.array(F.lit(ANY_RECORD))))
        .join(musts, ["query_id", "grp"])
        .groupBy("query_id")
        .agg(
            F.collect_list(F.struct("must", "units")).alias("groups"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("driver")))).alias("drivers"),
        )
    )


def _score(groups: Column, tokens: Column) -> Column:
    """Rank of a record's tokens for a query, NULL when no group matches."""

    def frequency(unit: Column) -> Column:
        forms = unit["words"][0]["forms"]
        alone = F.aggregate(
            forms, F.lit(0), lambda acc, w: acc + F.size(tokens) - F.size(F.array_remove(tokens, w))
        )
        phrase = F.size(
            F.filter(
                F.sequence(F.lit(0), F.size(tokens) - 1),
                lambda p: F.forall(
                    unit["words"], lambda w: F.array_contains(w["forms"], F.get(tokens, p + w["off"]))
                ),
            )
        )
        return F.when(F.size(unit["words"]) == 1, alone).otherwise(phrase)

    def group_score(units: Column) -> Column:
        counted = F.transform(
            units, lambda u: F.struct(u["negated"].alias("negated"), frequency(u).alias("tf"))
        )

        def judged(found: Column) -> Column:
            fits = F.forall(found, lambda x: (x["tf"] > 0) != x["negated"])
            value = F.aggregate(
                found,
                F.lit(0.0),
                lambda acc, x: acc + F.when(x["negated"], F.lit(0.0)).otherwise(x["tf"] / (x["tf"] + 1.0)),
            )
            return F.when(fits, value)

        return let(counted, judged)

    complete = F.filter(groups, lambda g: F.size(F.array_except(g["must"], tokens)) == 0)
    scores = F.filter(
        F.transform(complete, lambda g: group_score(g["units"])), lambda s: s.isNotNull()
    )
    return let(
        scores,
        lambda s: F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x)),
    )


def match(
    queries: DataFrame,
    entries: DataFrame,
    stemming: bool = True,
    vocabulary: DataFrame | None = None,
    text: str = "content",
    max_broadcast_units: int = MAX_BROADCAST_UNITS,
) -> DataFrame:
    """The matching entries per query, all their columns plus query_id and rank.

    Queries of up to `max_broadcast_units` units in
    all travel to the records; more of them meet the records in a join of (id, token) pairs.
    """
    if vocabulary is None:
        vocabulary = build_vocabulary(entries, text, stemming)
    plan = cut_lineage(_query_table(parse_queries(queries), vocabulary, stemming))
    seeds = plan.select("query_id", "groups", "drivers", F.explode("drivers").alias("_token"))
    docs = entries.withColumn("_words", words(F.col(text)))
    keys = F.array_distinct("_words")
    if plan.filter(F.array_contains("drivers", ANY_RECORD)).limit(1).count():
        keys = F.concat(keys, F.array(F.lit(ANY_RECORD)))
    weight = F.aggregate("groups", F.lit(0), lambda acc, g: acc + F.size(g["units"]))
    load = seeds.agg(F.sum(weight)).first()[0] or 0
    if load <= max_broadcast_units:
        met = docs.withColumn("_token", F.explode(keys)).join(
            F.broadcast(seeds), "_token"
        )
        # A record met through several rare words of a query counts once.
        met_by = F.filter("drivers", lambda d: (d == ANY_RECORD) | F.array_contains(F.col("_words"), d))
        chosen = F.col("_token") == met_by[0]
    else:
        tokens = docs.select("id", F.explode(keys).alias("_token"))
        pairs = tokens.join(seeds.select("_token", "query_id"), "_token").select("id", "query_id").distinct()
        met = docs.join(pairs, "id").join(plan, "query_id").withColumn("_token", F.lit(None))
        chosen = F.lit(True)
    # A generator keeps both tests above the join and drops the misses.
    rank = F.when(chosen, _score(F.col("groups"), F.col("_words")))
    score = F.filter(F.array(rank), lambda s: s.isNotNull())
    ranked = met.withColumn("_rank", F.explode(score)).withColumn("rank", F.round("_rank", 6))
    return ranked.drop("_words", "_token", "_rank", "groups", "drivers")
