"""Entity co-occurrence graph: extraction, upserts, search and the gated one-hop view."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage
from .defenses import read_defenses
from .gates import Rule, read_gate
from .ordering import first_n
from .ranking import clamp_limit

# Which entity types relate, in emission order.
RELATION_RULES = (
    ("person", "works_on", "project"),
    ("person", "member_of", "organization"),
    ("project", "uses", "technology"),
    ("organization", "develops", "project"),
)


def extract_entities(
    entries: DataFrame, extra: dict[str, str] | None = None, carry: list[str] | None = None
) -> DataFrame:
    """(memory_id, pos, name, entity_type, confidence), first spelling per (lower name, type)."""
    carry = carry or []
    found = entries.select(
        F.col("id").alias("memory_id"),
        *carry,
        F.posexplode(tx.entity_structs(F.col("content"), extra)).alias("pos", "e"),
    )
    return (
        found.groupBy(
            "memory_id", *carry, F.col("e.entity_type").alias("entity_type"), F.lower("e.name").alias("_key")
        )
        .agg(F.min(F.struct("pos", "e")).alias("f"))
        .select(
            "memory_id",
            *carry,
            F.col("f.pos").alias("pos"),
            F.col("f.e.name").alias("name"),
            "entity_type",
            F.col("f.e.confidence").alias("confidence"),
        )
    )


def extract_relations(mentions: DataFrame, cap: int | None = None) -> DataFrame:
    """(memory_id, ord, subject, subject_type, predicate, object, object_type).

    All pairs of a record's own names, in rule, subject, object order. With `cap` only the first
    so many of a record count, and so the first `cap` names of each type are enough.
    """
    heads = mentions.select("memory_id", "pos", "name", "entity_type")
    if cap is not None:
        heads = first_n(heads, ["memory_id", "entity_type"], [F.col("pos")], cap)
    lists = heads.groupBy("memory_id").agg(
        *[
            F.transform(
                F.array_sort(
                    F.collect_list(F.when(F.col("entity_type") == kind, F.struct("pos", "name")))
                ),
                lambda x: x["name"],
            ).alias(kind)
            for kind in ("person", "project", "organization", "technology")
        ]
    )

    def pairs(subject: str, predicate: str, obj: str) -> Column:
        return F.flatten(
            F.transform(
                F.col(subject),
                lambda s: F.transform(
                    F.col(obj),
                    lambda o: F.struct(
                        s.alias("subject"), F.lit(subject).alias("subject_type"),
                        F.lit(predicate).alias("predicate"),
                        o.alias("object"), F.lit(obj).alias("object_type"),
                    ),
                ),
            )
        )

    every = F.concat(*[pairs(*rule) for rule in RELATION_RULES])
    kept = every if cap is None else F.slice(every, 1, cap)
    return lists.select("memory_id", F.posexplode(kept).alias("ord", "r")).select(
        "memory_id", "ord", "r.*"
    )


def entity_id(name: Column, entity_type: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", entity_type, name), 256)


def upsert_entities(mentions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(entity_id, name, entity_type, aliases): unique per (name, type), aliases only grow."""
    new = mentions.select(
        "name",
        "entity_type",
        F.col("aliases") if "aliases" in mentions.columns else F.array().cast("array<string>").alias("aliases"),
    )
    both = new if known is None else new.unionByName(known.select("name", "entity_type", "aliases"))
    alias = both.select("name", "entity_type", F.explode_outer("aliases").alias("alias"))
    return (
        alias.groupBy("name", "entity_type")
        .agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
        .withColumn("entity_id", entity_id(F.col("name"), F.col("entity_type")))
    )


def links(mentions: DataFrame, relation: str = "mentions") -> DataFrame:
    """(memory_id, entity_id, relation, confidence): the first link of a pair stays."""
    return (
        mentions.groupBy("memory_id", entity_id(F.col("name"), F.col("entity_type")).alias("entity_id"))
        .agg(F.min_by("confidence", "pos").alias("confidence"))
        .withColumn("relation", F.lit(relation))
    )


def evidence(relations: DataFrame) -> DataFrame:
    """(subject_id, predicate, object_id, memory_id), one row per supporting record."""
    return relations.select(
        entity_id(F.col("subject"), F.col("subject_type")).alias("subject_id"),
        "predicate",
        entity_id(F.col("object"), F.col("object_type")).alias("object_id"),
        "memory_id",
    ).dropDuplicates()


def upsert_relations(observations: DataFrame) -> DataFrame:
    """Edges from (subject_id, predicate, object_id, seen_at, confidence) observations."""
    return observations.groupBy("subject_id", "predicate", "object_id").agg(
        F.count("*").alias("evidence_count"),
        F.min("seen_at").alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"),
        F.max("confidence").alias("confidence"),
    )


def matches_name(name: str) -> Column:
    """Case-insensitive substring of the name, or an exact alias."""
    return F.col("name").ilike(f"%{name}%") | F.array_contains("aliases", name)


def entity_search(
    entries: DataFrame, entities: DataFrame, mention_links: DataFrame, name: str, limit: int = 20
) -> DataFrame:
    """Current records mentioning a matching entity, newest first."""
    hit = entities.filter(matches_name(name)).select("entity_id")
    ids = mention_links.join(hit, "entity_id", "left_semi").select(F.col("memory_id").alias("id")).distinct()
    return (
        entries.filter(F.col("valid_until").isNull())
        .join(ids, "id", "left_semi")
        .orderBy(F.col("created_at").desc(), "id")
        .limit(clamp_limit(limit))
    )


def entity_list(entities: DataFrame, entity_type: str | None = None) -> DataFrame:
    """All entities, or those of one type, by type and name."""
    if entity_type is not None:
        entities = entities.filter(F.col("entity_type") == entity_type)
    return entities.orderBy("entity_type", "name")


def resolve_entity(entities: DataFrame, name: str) -> DataFrame:
    """The one entity a name stands for: exact first, else fuzzy; id settles ties."""
    return (
        entities.filter(matches_name(name))
        .orderBy((F.col("name") == name).desc(), "entity_id")
        .limit(1)
    )


def entity_graph(
    target: DataFrame,
    entities: DataFrame,
    edges: DataFrame,
    edge_evidence: DataFrame,
    mention_links: DataFrame,
    visible: DataFrame,
) -> DataFrame:
    """Relations of the target entity counted over `visible` (id) current records only."""
    who = target.select(F.col("entity_id").alias("target_id"))
    ends = edges.withColumn("end", F.explode(F.array_distinct(F.array("subject_id", "object_id"))))
    near = ends.join(who, F.col("end") == F.col("target_id")).drop("end")
    seen = edge_evidence.join(visible.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    names = entities.select("entity_id", "name")
    return (
        near.join(seen, ["subject_id", "predicate", "object_id"])
        .groupBy("subject_id", "predicate", "object_id", "target_id", "confidence")
        .agg(F.count_distinct("memory_id").alias("evidence_count"))
        .join(names.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("subject")), "subject_id")
        .join(names.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object")), "object_id")
        .select(
            "predicate", "subject", "object", "evidence_count", "confidence",
            F.when(F.col("subject_id") == F.col("target_id"), F.lit("outgoing"))
            .otherwise(F.lit("incoming")).alias("direction"),
        )
    )


def memory_count(target: DataFrame, mention_links: DataFrame, visible: DataFrame) -> DataFrame:
    return (
        mention_links.join(target.select("entity_id"), "entity_id", "left_semi")
        .join(visible.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
        .agg(F.count_distinct("memory_id").alias("memory_count"))
    )


def gated_entity_graph(
    entries: DataFrame,
    entities: DataFrame,
    edges: DataFrame,
    edge_evidence: DataFrame,
    mention_links: DataFrame,
    name: str,
    rules: list[Rule],
    actor: str,
    now: datetime | int,
) -> DataFrame:
    """One-hop view as an agent may see it: flagged evidence out, visibility rules on the
    evidence, result limits on the relations."""
    target = cut_lineage(resolve_entity(entities, name))
    ids = mention_links.join(target.select("entity_id"), "entity_id", "left_semi").select(
        F.col("memory_id").alias("id")
    )
    own = entries.filter(F.col("valid_until").isNull()).join(ids, "id", "left_semi")
    clean = read_defenses(own, now).filter("NOT injection_flagged")
    newest = [F.col("created_at").desc(), F.col("id")]
    visible = read_gate(clean, [r for r in rules if r.rule_type != "max_results"], actor, newest)
    found = entity_graph(target, entities, edges, edge_evidence, mention_links, visible)
    order = [F.col("evidence_count").desc(), F.col("subject"), F.col("predicate"), F.col("object")]
    return read_gate(found, [r for r in rules if r.rule_type == "max_results"], actor, order)
