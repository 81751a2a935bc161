"""Signed policy rules compiled into Columns and applied to writes and reads."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import canonical_json, canonical_rule, chained_hash
from ..schema import CONTENT_CLASSES, MEMORY_TYPES, READ_RULES, WRITE_RULES
from .ordering import first_n

MAX_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    rule_type: str
    parameters: dict
    description: str = ""
    applies_to: str = "all"


def rule_valid(rule_type: Column, parameters: Column) -> Column:
    """Per rule row: are the parameters (JSON text) usable by the rule's gate?"""

    def raw(key: str) -> Column:
        return F.variant_get(F.try_parse_json(parameters), f"$.{key}", "variant")

    def kind(key: str) -> Column:
        return F.coalesce(F.schema_of_variant(raw(key)), F.lit("missing"))

    def text(key: str) -> Column:
        return F.get_json_object(parameters, f"$.{key}")

    def choice(key: str, allowed: tuple[str, ...]) -> Column:
        return (kind(key) == "STRING") & text(key).isin(*allowed)

    def unit(key: str) -> Column:
        number = kind(key).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        return number & text(key).try_cast("double").between(0.0, 1.0)

    return F.coalesce(
        F.when(rule_type.isin("exclude_memory_type", "deny_write_memory_type"), choice("memory_type", MEMORY_TYPES))
        .when(rule_type == "min_trust_floor", unit("floor"))
        .when(rule_type == "exclude_tag", (kind("tag") == "STRING") & (F.trim(text("tag")) != ""))
        .when(rule_type == "exclude_content_class", choice("content_class", CONTENT_CLASSES))
        .when(
            rule_type == "max_results",
            (kind("max_results") == "BIGINT") & (text("max_results").try_cast("bigint") >= 0),
        )
        .when(
            rule_type == "max_trust_for_content_class",
            choice("content_class", CONTENT_CLASSES) & unit("max_trust"),
        ),
        F.lit(False),
    )


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("revoked_at").isNull() & F.col("active")).orderBy("created_at", "id")


def apply_revocations(rules: DataFrame, revocations: DataFrame) -> DataFrame:
    """Rules without a revocation event (rule_id); nothing is deleted from the rule log."""
    return rules.join(revocations.select(F.col("rule_id").alias("id")), "id", "left_anti")


def verify_rules(rules: DataFrame, keyring: Mapping[str, str]) -> DataFrame:
    """Signature check of every rule, revoked ones included."""
    canonical = canonical_rule(
        F.col("rule_type"),
        canonical_json(F.col("parameters")),
        F.col("description"),
        F.col("applies_to"),
        F.col("created_at"),
    )
    expected = chained_hash(keyring, F.col("key_id"), canonical, F.lit(None).cast("string"))
    return rules.withColumn(
        "rule_ok", F.coalesce(expected == F.col("rule_hash"), F.lit(False))
    )


def load_rules(rules: DataFrame) -> list[Rule]:
    """Active rules, oldest first. A rule set is configuration; an oversized one is refused."""
    rows = (
        active_rules(rules)
        .select("rule_type", "parameters", "description", "applies_to")
        .limit(MAX_RULES + 1)
        .collect()
    )
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} active rules")
    return [
        Rule(r["rule_type"], json.loads(r["parameters"] or "{}"), r["description"] or "", r["applies_to"])
        for r in rows
    ]


def _usable(rule: Rule) -> bool:
    """Driver-side twin of rule_valid for the already loaded rules."""
    p = rule.parameters

    def choice(key, allowed):
        return isinstance(p.get(key), str) and p[key] in allowed

    def unit(key):
        v = p.get(key)
        return isinstance(v, (int, float)) and not isinstance(v, bool) and 0.0 <= v <= 1.0

    checks = {
        "exclude_memory_type": lambda: choice("memory_type", MEMORY_TYPES),
        "deny_write_memory_type": lambda: choice("memory_type", MEMORY_TYPES),
        "min_trust_floor": lambda: unit("floor"),
        "exclude_tag": lambda: isinstance(p.get("tag"), str) and p["tag"].strip() != "",
        "exclude_content_class": lambda: choice("content_class", CONTENT_CLASSES),
        "max_results": lambda: type(p.get("max_results")) is int and p["max_results"] >= 0,
        "max_trust_for_content_class": lambda: choice("content_class", CONTENT_CLASSES)
        and unit("max_trust"),
    }
    return rule.rule_type in checks and checks[rule.rule_type]()


def _in_scope(rule: Rule, actor: Column) -> Column:
    if rule.applies_to == "all":
        return F.lit(True)
    return F.contains(F.coalesce(actor, F.lit("")), F.lit(rule.applies_to))


def write_gate(
    memory_type: Column, content_class: Column, trust: Column, actor: Column, rules: list[Rule]
) -> dict[str, Column]:
    """`deny_reason` of the first rule that blocks, and the trust after the caps before it."""
    deny = F.lit(None).cast("string")
    capped = trust.cast("double")
    for rule in rules:
        if rule.rule_type in READ_RULES:
            continue
        scope, p = _in_scope(rule, actor), rule.parameters
        if rule.rule_type not in WRITE_RULES:
            hit, why = scope, F.lit(f"unknown rule type '{rule.rule_type}'; write denied")
        elif not _usable(rule):
            hit, why = scope, F.lit(f"invalid stored rule '{rule.rule_type}'; write denied")
        elif rule.rule_type == "deny_write_memory_type":
            hit = scope & (memory_type == p["memory_type"])
            why = F.lit(rule.description or f"writes of type '{p['memory_type']}' are denied")
        else:
            cap = scope & (content_class == p["content_class"]) & deny.isNull()
            capped = F.when(cap, F.least(capped, F.lit(float(p["max_trust"])))).otherwise(capped)
            continue
        deny = F.when(deny.isNull() & hit, why).otherwise(deny)
    return {"deny_reason": deny, "trust_score": capped}


def read_gate(
    results: DataFrame,
    rules: list[Rule],
    actor: str,
    order: list[Column],
    per: list[str] | None = None,
) -> DataFrame:
    """Rules in order over ranked results; `per` names the query columns for result limits.

    A row missing the field a rule needs is suppressed; an unknown or invalid rule suppresses
    everything. Result limits act on what the rules before them left.
    """
    per = per or []
    for rule in rules:
        if rule.applies_to != "all" and rule.applies_to not in actor:
            continue
        if rule.rule_type in WRITE_RULES:
            continue
        p = rule.parameters
        if not _usable(rule):
            return results.filter(F.lit(False))
        if rule.rule_type == "exclude_memory_type":
            results = results.filter(F.col("memory_type") != p["memory_type"])
        elif rule.rule_type == "min_trust_floor":
            results = results.filter(F.col("effective_trust") >= float(p["floor"]))
        elif rule.rule_type == "exclude_content_class":
            results = results.filter(F.col("content_class") != p["content_class"])
        elif rule.rule_type == "exclude_tag":
            tags = F.from_json(F.get_json_object("metadata", "$.tags"), "array<string>")
            results = results.filter(~F.array_contains(tags, p["tag"]))
        elif rule.rule_type == "max_results":
            n = p["max_results"]
            if per:
                results = first_n(results, per, order, n, out="_rank").drop("_rank")
            else:
                results = results.orderBy(*order).limit(n)
    return results
