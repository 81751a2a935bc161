"""Mixing sources to target weights by hierarchical budgeting.

Weights stand at the branches of a tree of domain, language and source. A budget of tokens goes
down the tree. At each node it is shared among the children by weight; a child that can't use its
share (it has so many tokens, times the allowed epochs) leaves the rest to its siblings. What a
whole node can't use has by then gone to the node's own siblings, since a node's capacity is the
sum of its children's. So shortages pass to siblings before ancestors.

A leaf fills its budget with epochs over its documents, each in a seeded order of its own, and
takes a prefix of the last one.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.scratch import written
from ledgerlake.llm.tokens import with_token_counts

DOCS_PER_BUCKET = 1_000


def weight_of(key: Column, weights: Mapping[str, int], otherwise: int) -> Column:
    """The whole-number weight listed for a key, or the common one."""
    if any(w < 0 or w != int(w) for w in [*weights.values(), otherwise]):
        raise ValueError("weights must be whole numbers from 0")
    if not weights:
        return F.lit(otherwise).cast("bigint")
    listed = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(int(w)).cast("bigint"))])
    return F.coalesce(listed[key], F.lit(otherwise).cast("bigint"))


def share_down(children: DataFrame, parent: list[str], allotted: str, weight: str, capacity: str, name: str) -> DataFrame:
    """The children with their share of their parent's amount, filled evenly by weight up to capacity.

    In the order of capacity per weight, a child is full while its capacity is at most what an even
    rate over the rest would give it. Sums run in that order, so the result is the same every time.
    """
    order = Window.partitionBy(*parent).orderBy(F.col(capacity) / F.col(weight), F.col(weight), *[c for c in ("domain", "lang", "source") if c in children.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    left = F.col(allotted) - F.coalesce(F.sum(capacity).over(before), F.lit(0))
    weights_left = F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0))
    rated = children.withColumn("__rate", left / weights_left)
    rated = rated.withColumn("__full", F.col(capacity) <= F.col("__rate") * F.col(weight))
    # The rate that holds for all children that aren't full is that of the first of them.
    rate = F.max(F.when(~F.col("__full"), F.col("__rate"))).over(whole)
    return rated.withColumn(
        name, F.when(F.col("__full"), F.col(capacity).cast("double")).otherwise(F.least(rate * F.col(weight), F.col(capacity).cast("double")))
    ).drop("__rate", "__full")


def budgets(leaves: DataFrame, domains: Mapping[str, int], languages: Mapping[str, int], sources: Mapping[str, int],
            budget: int | None = None, share: float | None = None, max_epochs: int = 4, otherwise: int = 1) -> DataFrame:
    """Leaves (domain, lang, source, tokens, n_docs) with their `budget` in tokens.

    The budget is a number of tokens, or a share of all tokens there are. A weight of 0 shuts a
    branch out. A null name is a branch of its own with the common weight. If the whole tree can't
    use the budget, every leaf gets all it can use.
    """
    wanted = F.lit(float(budget)) if budget is not None else F.sum("tokens").over(Window.partitionBy()) * F.lit(float(share))
    tree = (
        leaves.withColumn("budget_wanted", wanted)
        .withColumns({"w1": weight_of(F.col("domain"), domains, otherwise), "w2": weight_of(F.col("lang"), languages, otherwise), "w3": weight_of(F.col("source"), sources, otherwise)})
        .where("w1 > 0 and w2 > 0 and w3 > 0 and tokens > 0")
        .withColumn("c3", F.col("tokens") * max_epochs)
    )
    langs = tree.groupBy("domain", "lang").agg(F.max("w2").alias("w2"), F.sum("c3").alias("c2"), F.max("w1").alias("w1"), F.max("budget_wanted").alias("budget_wanted"))
    tops = langs.groupBy("domain").agg(F.max("w1").alias("w1"), F.sum("c2").alias("c1"), F.max("budget_wanted").alias("budget_wanted"))
    tops = tops.withColumn("b0", F.least("budget_wanted", F.sum("c1").over(Window.partitionBy())))
    tops = share_down(tops, [], "b0", "w1", "c1", "b1").select(F.col("domain").alias("d"), "b1")
    langs = langs.join(tops, langs["domain"].eqNullSafe(tops["d"])).drop("d")
    langs = share_down(langs, ["domain"], "b1", "w2", "c2", "b2").select(F.col("domain").alias("d"), F.col("lang").alias("l"), "b2")
    tree = tree.join(langs, tree["domain"].eqNullSafe(langs["d"]) & tree["lang"].eqNullSafe(langs["l"]))
    return share_down(tree, ["domain", "lang"], "b2", "w3", "c3", "budget").select("domain", "lang", "source", "tokens", "n_docs", "budget")


def counted(docs: DataFrame, carry: list[str] | None = None, path: str | None = None) -> DataFrame:
    """A written table of (row, source, lang, n_tokens, order_key) for documents.

    `row` holds the columns to carry along, all of them if none are named, so their names can't
    clash. A null text is empty; the end of a document is a token. `order_key` is the hash of id and
    text that the order of an epoch starts from.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row")
    rows = docs.select(row, "source", "lang", "text", F.xxhash64("doc_id", "text").alias("order_key"))
    return written(with_token_counts(rows, name="n_tokens", path=path, extra=1).drop("text"))


def mix(docs: DataFrame, domain: Column, domains: Mapping[str, int], languages: Mapping[str, int], sources: Mapping[str, int],
        seed: int = 17, docs_per_bucket: int = DOCS_PER_BUCKET, **how) -> DataFrame:
    """Rows of a table of `counted` that the mix takes, once per epoch, with `domain` and `epoch` from 0.

    In each epoch a leaf's documents stand in the order of a hash of seed, epoch and `order_key`. Full
    epochs take all of them; the last takes documents while the tokens before them are fewer than
    what is left of the budget, so that the last document may reach over it. Repeated rows are
    documents of their own; where they can't be told apart, either may be taken. No documents, no rows.

    A prefix is found by buckets of hashes: sums per bucket tell which buckets lie whole before the
    cut, and only the bucket that holds the cut is put in order. A bucket has about
    `docs_per_bucket` documents, however large the leaf.
    """
    docs = docs.withColumn("domain", domain)
    leaves = docs.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    plan = written(budgets(leaves, domains, languages, sources, **how))
    most = plan.agg(F.max("n_docs")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, most / docs_per_bucket))))
    whole = F.floor(F.col("budget") / F.col("tokens"))
    plan = plan.select(
        F.struct("domain", "lang", "source").alias("leaf"), whole.cast("int").alias("full"), (F.col("budget") - whole * F.col("tokens")).alias("rest")
    )

    rows = docs.withColumn("__leaf", F.struct("domain", "lang", "source"))
    rows = rows.join(plan, rows["__leaf"].eqNullSafe(plan["leaf"])).drop("leaf")
    taken_whole = rows.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    last = rows.where("rest > 0").withColumn("epoch", F.col("full"))
    last = last.withColumn("__h", F.xxhash64(F.lit(seed), "epoch", "order_key"))
    # The order is that of the unsigned hash, of which the bucket is the head.
    last = last.withColumn("__bucket", F.shiftrightunsigned("__h", 64 - bits) if bits else F.lit(0).cast("bigint"))
    sums = written(last.groupBy("__leaf", "__bucket").agg(F.sum("n_tokens").alias("__in")))
    ahead = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("__leaf").alias("leaf"), F.col("__bucket").alias("bucket"), "__in").withColumn("__before", F.coalesce(F.sum("__in").over(ahead), F.lit(0)))
    last = last.join(sums, last["__leaf"].eqNullSafe(sums["leaf"]) & (last["__bucket"] == sums["bucket"])).drop("leaf", "bucket")
    inside = last.where("__before + __in <= rest")
    cut = last.where("__before < rest and __before + __in > rest")
    order = Window.partitionBy("__leaf").orderBy(F.shiftrightunsigned("__h", 1), F.col("__h").bitwiseAND(1), "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("__before", F.col("__before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).where("__before < rest")
    out = [*[f"`{c}`" for c in docs.columns], "epoch"]
    return taken_whole.select(*out).unionByName(inside.select(*out)).unionByName(cut.select(*out))
