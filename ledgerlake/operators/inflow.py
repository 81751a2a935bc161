"""Near copies among submissions, settled in their order whatever the batches they come in.

A submission is compared with the records that were promoted before it. So whether it is promoted
depends on earlier submissions, which may stand in the same batch. Submissions of one vector form a
class, and at most one of a class is promoted: from then on the rest are exact copies of it. Classes
within the merge distance of each other form components, which are walked in order of submission.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .settling import SLICE_ROWS, components, sliced, walk

ORDER = ("submitted_at", "id")


def promoted(members: DataFrame, near: DataFrame, prior: DataFrame, reject: float, merge: float, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(class_id, id, submitted_at) of the submissions that become records.

    members(id, class_id, submitted_at, weak): those that nothing but a near copy can stop; a weak one
    needs a record within the merge distance, or it is turned away. near(a, b, distance): near classes,
    once each. prior(class_id, distance): the nearest record that was there before.
    """
    stops = members.join(prior.filter(F.col("distance") < reject).select("class_id"), "class_id", "left_anti")
    backed = prior.filter((F.col("distance") >= reject) & (F.col("distance") < merge)).select("class_id", F.lit(True).alias("backed"))
    ready = stops.join(backed, "class_id", "left").select("id", "class_id", "submitted_at", (F.col("weak") & F.col("backed").isNull()).alias("weak"))
    # The first strong one of a class settles it; only weak ones before it can matter.
    first = ready.groupBy("class_id").agg(F.min(F.when(~F.col("weak"), F.struct(*ORDER))).alias("first"))
    rows = cut_lineage(
        ready.join(first, "class_id").filter(F.col("first").isNull() | (F.struct(*ORDER) <= F.col("first"))).drop("first")
    )
    links = cut_lineage(
        near.filter(F.col("distance") < merge).select("a", "b", (F.col("distance") < reject).alias("copy"))
        .join(rows.select(F.col("class_id").alias("a")).distinct(), "a", "left_semi")
        .join(rows.select(F.col("class_id").alias("b")).distinct(), "b", "left_semi")
    )
    if links.isEmpty():
        return cut_lineage(first_of(rows.filter("NOT weak")))
    roots = components(links)
    edges = cut_lineage(
        links.select(F.col("a").alias("class_id"), F.col("b").alias("other"), "copy")
        .unionByName(links.select(F.col("b").alias("class_id"), F.col("a").alias("other"), "copy"))
        .join(roots.withColumnRenamed("node", "class_id"), "class_id")
    )
    degree = edges.groupBy("class_id").agg(F.count("*").alias("degree"))
    placed = rows.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").join(degree, "class_id", "left").withColumn(
        "root", F.coalesce("root", "class_id")
    )
    alone = placed.filter("degree IS NULL AND NOT weak").select("class_id", "id", "submitted_at")
    slices = sliced(placed.filter("degree IS NOT NULL"), "root", list(ORDER), slice_rows, F.col("degree") + 1)
    kind = rows.schema["class_id"].dataType.simpleString()

    def known(own: DataFrame, done: DataFrame | None) -> DataFrame:
        touched = edges.join(own.select("class_id").distinct(), "class_id", "left_semi")
        if done is None:
            return touched.withColumn("settled", F.lit(False)).withColumn("gone", F.lit(False))
        before = done.filter("accepted").select("class_id").distinct()
        return (
            touched.join(before.select(F.col("class_id").alias("other"), F.lit(True).alias("settled")), "other", "left")
            .join(before.withColumn("gone", F.lit(True)), "class_id", "left")
            .fillna(False, ["settled", "gone"])
        )

    def settle(own: pd.DataFrame, touched: pd.DataFrame) -> pd.DataFrame:
        copies, others = {}, {}
        for row in touched.itertuples(index=False):
            (copies if row.copy else others).setdefault(row.class_id, []).append(row.other)
        done = set(touched.loc[touched["settled"], "other"]) | set(touched.loc[touched["gone"], "class_id"])
        own, accepted = own.sort_values("place", kind="stable"), []
        for row in own.itertuples(index=False):
            fine = (
                row.class_id not in done
                and not any(o in done for o in copies.get(row.class_id, ()))
                and (not row.weak or any(o in done for o in others.get(row.class_id, ())))
            )
            accepted.append(fine)
            if fine:
                done.add(row.class_id)
        return own[["root", "place", "class_id"]].assign(accepted=accepted)

    settled = walk(
        slices.select("root", "place", "slice", "class_id", "weak"), "root", known, settle, f"root {kind}, place bigint, class_id {kind}, accepted boolean"
    )
    taken = slices.join(settled.filter("accepted").select("root", "place"), ["root", "place"], "left_semi").select("class_id", "id", "submitted_at")
    return cut_lineage(first_of(alone).unionByName(taken))


def first_of(rows: DataFrame) -> DataFrame:
    """The first submission of each class."""
    least = rows.groupBy("class_id").agg(F.min(F.struct(*ORDER)).alias("m"))
    return least.select("class_id", F.col("m.id").alias("id"), F.col("m.submitted_at").alias("submitted_at"))


def closest_before(everyone: DataFrame, near: DataFrame, done: DataFrame, prior: DataFrame) -> DataFrame:
    """(id, duplicate_id, distance): each submission's nearest record among older ones and those promoted before it.

    everyone(id, class_id, submitted_at); done: what `promoted` gave; prior(class_id, duplicate_id, distance).
    Ties go to the smaller id.
    """
    record = done.select(F.col("class_id").alias("other"), F.col("id").alias("duplicate_id"), F.col("submitted_at").alias("since"))
    both = (
        near.select(F.col("a").alias("class_id"), F.col("b").alias("other"), "distance")
        .unionByName(near.select(F.col("b").alias("class_id"), F.col("a").alias("other"), "distance"))
        .unionByName(done.select("class_id", F.col("class_id").alias("other"), F.lit(0.0).alias("distance")))
        .join(record, "other")
    )
    earlier = (F.col("submitted_at") > F.col("since")) | ((F.col("submitted_at") == F.col("since")) & (F.col("id") > F.col("duplicate_id")))
    inside = everyone.join(both.drop("other"), "class_id").filter(earlier).select("id", "duplicate_id", "distance")
    outside = everyone.join(prior, "class_id").select("id", "duplicate_id", "distance")
    best = inside.unionByName(outside).groupBy("id").agg(F.min(F.struct("distance", "duplicate_id")).alias("m"))
    return best.select("id", "m.duplicate_id", "m.distance")
