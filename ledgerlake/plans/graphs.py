"""Entity graph and curation."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import trust as tr
from ..operators import curation, gates, graph
from ..session import cut_lineage
from .records import _ci
from .registry import ORACLES, query
from .views import A, EFF, EVENTS_NOW, M, NOW, audit, memory, table

# Common words of the test texts as site-specific gazetteer names.
NAMES = {"the": "project", "les": "project", "and": "technology", "dans": "technology", "der": "technology"}

# White space, and letters, marks and digits beyond ASCII, as the other engine has to be told of them.
_SPACE = r"[\s\x0b\x{85}\p{Z}]"
_WORD = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{M}]|[^\x00-\x7F\P{N}]"

MENTION_CTE = (
    "listed AS ("
    + " UNION ALL ".join(
        f"SELECT id AS memory_id, '{n}' AS name, '{t}' AS entity_type, CAST({i} AS BIGINT) AS pos FROM memory WHERE regexp_matches(content, '{_ci(n)}')"
        for i, (n, t) in enumerate({**tx.GAZETTEER, **NAMES}.items())
    )
    + "),"
    + rf"""
lists AS (SELECT id, regexp_extract_all(content, 'https?://([^/\s:]+)', 1) AS hosts,
  regexp_extract_all(content, '[\p{{L}}\p{{M}}\p{{N}}_.+-]+@([\p{{L}}\p{{M}}\p{{N}}_-]+(?:\.[\p{{L}}\p{{M}}\p{{N}}_-]+)+)', 1) AS mails,
  regexp_extract_all(regexp_replace(content, '{_WORD}', '0', 'g'), '\b[A-Z][A-Za-z.]*(?:{_SPACE}+[A-Z][a-z]+){{1,2}}\b', 0) AS persons FROM memory),
claimed AS (SELECT memory_id, list(lower(name)) AS names FROM listed GROUP BY 1),
one AS (SELECT id, 'organization' AS entity_type, regexp_replace(lower(unnest(hosts)), '^www\.', '') AS name, 1000 + generate_subscripts(hosts, 1) AS pos FROM lists
 UNION ALL SELECT id, 'organization', regexp_replace(lower(unnest(mails)), '^www\.', ''), 1000000 + generate_subscripts(mails, 1) FROM lists
 UNION ALL SELECT id, 'person', unnest(persons), 2000000 + generate_subscripts(persons, 1) FROM lists),
found AS (SELECT * FROM listed UNION ALL SELECT one.id, one.name, one.entity_type, one.pos FROM one LEFT JOIN claimed c ON c.memory_id = one.id
 WHERE one.name <> '' AND (one.entity_type <> 'person'
  OR NOT list_has_any(list_append(string_split_regex(lower(one.name), '{_SPACE}+'), lower(one.name)), coalesce(c.names, [])))),
men AS MATERIALIZED (SELECT memory_id, arg_min(name, pos) AS name, entity_type, min(pos) AS pos FROM found GROUP BY memory_id, entity_type, lower(name)),
rules AS (SELECT * FROM (VALUES ('person', 'works_on', 'project'), ('person', 'member_of', 'organization'), ('project', 'uses', 'technology'),
  ('organization', 'develops', 'project')) v(s, predicate, o)),
rel AS (SELECT a.memory_id, a.name AS subject, a.entity_type AS subject_type, rules.predicate, b.name AS object, b.entity_type AS object_type
 FROM men a JOIN rules ON rules.s = a.entity_type JOIN men b ON b.memory_id = a.memory_id AND b.entity_type = rules.o)"""
)


def mentions(spark, sf):
    """Mentions of the whole extractor: persons and the built-in names too."""
    return graph.extract_entities(memory(spark, sf), NAMES)


def parts(spark, sf):
    rows = memory(spark, sf)
    men = cut_lineage(mentions(spark, sf))
    entities = graph.upsert_entities(men.withColumn("aliases", F.array(F.upper("name"))))
    links = graph.links(men)
    evidence = graph.evidence(graph.extract_relations(men))
    seen = evidence.join(rows.select(F.col("id").alias("memory_id"), F.col("created_at").alias("seen_at")), "memory_id")
    edges = graph.upsert_relations(seen.withColumn("confidence", F.lit(1.0)))
    return rows, entities, links, evidence, edges


@query(f"WITH {M}, {MENTION_CTE} SELECT memory_id, name, entity_type FROM men")
def entity_mentions(spark, sf):
    return mentions(spark, sf).select("memory_id", "name", "entity_type")


@query()
def extract_entities(spark, sf):
    """All kinds over whole pages, persons and URL hosts included."""
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.concat_ws("\n", "url", "html").alias("content")
    )
    return graph.extract_entities(pages).select("memory_id", "name", "entity_type", "confidence")


@query(f"WITH {M}, {MENTION_CTE} SELECT memory_id, subject, predicate, object FROM rel")
def entity_relations(spark, sf):
    return graph.extract_relations(mentions(spark, sf)).select("memory_id", "subject", "predicate", "object")


@query(
    f"""WITH {M}, {MENTION_CTE} SELECT subject, predicate, object, count(*) AS evidence_count,
 min(created_epoch) AS first_seen, max(created_epoch) AS last_seen FROM rel JOIN memory m ON m.id = rel.memory_id GROUP BY subject, subject_type, predicate, object, object_type"""
)
def relation_upsert(spark, sf):
    _, entities, _, _, edges = parts(spark, sf)
    names = entities.select("entity_id", "name")
    out = edges.join(names.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("subject")), "subject_id")
    out = out.join(names.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object")), "object_id")
    return out.select(
        "subject", "predicate", "object", "evidence_count",
        F.unix_seconds("first_seen_at").alias("first_seen"), F.unix_seconds("last_seen_at").alias("last_seen"),
    )


@query(
    f"""WITH {M}, {MENTION_CTE}, n AS (SELECT name, entity_type, count(DISTINCT memory_id) AS memories FROM men GROUP BY 1, 2)
 SELECT name, entity_type, memories, CASE WHEN lower(name) = upper(name) THEN lower(name) ELSE concat(lower(name), '|', upper(name)) END AS aliases FROM n"""
)
def entity_upsert(spark, sf):
    """Entities of two loads: aliases are unioned, links are not repeated."""
    men = cut_lineage(mentions(spark, sf))
    once = graph.upsert_entities(men.withColumn("aliases", F.array(F.upper("name"))))
    twice = graph.upsert_entities(men.withColumn("aliases", F.array(F.lower("name"), F.upper("name"))), once)
    n = graph.links(men.unionByName(men)).groupBy("entity_id").agg(F.count("*").alias("memories"))
    return twice.join(n, "entity_id").select(
        "name", "entity_type", "memories", F.concat_ws("|", F.reverse("aliases")).alias("aliases")
    )


@query(
    f"""WITH {M}, {MENTION_CTE} SELECT id FROM memory WHERE valid_until_epoch IS NULL AND id IN
 (SELECT memory_id FROM men WHERE name ILIKE '%an%' OR upper(name) = 'an') ORDER BY created_epoch DESC, id LIMIT 20"""
)
def entity_search(spark, sf):
    rows, entities, links, _, _ = parts(spark, sf)
    return graph.entity_search(rows, entities, links, "an").select("id")


GRAPH_SQL = f"""WITH {M}, {MENTION_CTE},
 vis AS (SELECT id FROM memory WHERE valid_until_epoch IS NULL AND id % 17 <> 0 AND content_class <> 'external-untrusted'),
 who AS (SELECT name, entity_type FROM (SELECT DISTINCT name, entity_type FROM men) WHERE name ILIKE '%the%'
  ORDER BY name = 'THE' DESC, sha256(concat(entity_type, chr(31), name)) LIMIT 1),
 near AS (SELECT rel.*, rel.subject = who.name AND rel.subject_type = who.entity_type AS outgoing FROM rel, who
  WHERE (rel.subject = who.name AND rel.subject_type = who.entity_type) OR (rel.object = who.name AND rel.object_type = who.entity_type))
 SELECT predicate, subject, object, count(DISTINCT memory_id) AS evidence_count, 1.0 AS confidence,
  CASE WHEN outgoing THEN 'outgoing' ELSE 'incoming' END AS direction
 FROM near WHERE memory_id IN (SELECT id FROM vis) GROUP BY predicate, subject, subject_type, object, object_type, outgoing ORDER BY 4 DESC, 2, 1, 3 LIMIT 4"""


@query(GRAPH_SQL)
def entity_graph(spark, sf):
    rows, entities, links, evidence, edges = parts(spark, sf)
    rules = [
        gates.Rule("exclude_content_class", {"content_class": "external-untrusted"}),
        gates.Rule("max_results", {"max_results": 4}),
    ]
    return graph.gated_entity_graph(rows, entities, edges, evidence, links, "THE", rules, "agent", NOW)


@query(
    f"""WITH {M}, {MENTION_CTE} SELECT count(DISTINCT memory_id) AS memory_count FROM men
 WHERE name = 'and' AND memory_id IN (SELECT id FROM memory WHERE valid_until_epoch IS NULL)"""
)
def entity_memory_count(spark, sf):
    rows, entities, links, _, _ = parts(spark, sf)
    return graph.memory_count(graph.resolve_entity(entities, "and"), links, rows.filter("valid_until IS NULL"))


@query(
    f"""WITH {M}, {MENTION_CTE} SELECT DISTINCT name, entity_type FROM men WHERE entity_type = 'organization'"""
)
def entity_list(spark, sf):
    return graph.entity_list(graph.upsert_entities(mentions(spark, sf)), "organization").select("name", "entity_type")


# Earlier names of the same queries, kept for those who call them.
for fn in (
    entity_mentions, entity_relations, relation_upsert, entity_upsert, entity_search, entity_graph, entity_memory_count, entity_list,
):
    query(ORACLES[fn.__name__], name=f"{fn.__name__}_whole")(fn)


# --- curation ---


@query(
    f"""WITH {A} SELECT memory_id, count(*) AS accesses,
 CAST(max(greatest(0, floor(({EVENTS_NOW} - epoch(timestamp)) / 86400))) FILTER (timestamp = last) AS BIGINT) AS days_since
 FROM (SELECT *, max(timestamp) OVER (PARTITION BY memory_id) AS last FROM audit WHERE action = 'searched') GROUP BY 1"""
)
def access_counts(spark, sf):
    return curation.access_counts(audit(spark, sf), EVENTS_NOW)


@query(
    f"""WITH {M}, {A}, n AS (SELECT memory_id AS id, count(*) AS c, max(timestamp) AS last FROM audit WHERE action = 'searched' GROUP BY 1),
 j AS (SELECT m.id, m.memory_type, trust_score, created_epoch, coalesce(n.c, 0) AS c, 1 + m.id % 10 AS marked, m.id % 5 AS con,
   coalesce(floor(({EVENTS_NOW} - epoch(n.last)) / 86400), 0) AS since FROM memory m LEFT JOIN n USING (id)),
 k AS (SELECT *, CASE WHEN c = 0 THEN 0.0 ELSE least(c, 100) / 100.0 * CASE WHEN since <= 30 THEN 1.0 ELSE 0.5 END END AS frequency,
   pow(0.5, greatest(0, floor(({EVENTS_NOW} - created_epoch) / 86400.0)) / CASE memory_type WHEN 'procedural' THEN 180.0 WHEN 'episodic' THEN 90.0
    WHEN 'preference' THEN 365.0 ELSE 180.0 END) AS salience,
   greatest(1, least(10, CASE WHEN con > 2 THEN marked - least(marked - 1, con) ELSE marked END - CASE WHEN trust_score < 0.5 THEN 2 ELSE 0 END)) AS importance FROM j),
 s AS (SELECT *, greatest(0.0, least(1.0, importance / 10.0 * 0.4 + frequency * 0.3 + salience * 0.3 - least(1.0, con / 10.0) * 0.2)) AS sig FROM k)
 SELECT id, round(frequency, 6) AS frequency, round(salience, 6) AS salience, CAST(importance AS BIGINT) AS importance, round(sig, 6) AS significance,
  CASE WHEN sig >= 0.8 THEN 'L0' WHEN sig >= 0.6 THEN 'L1' WHEN sig >= 0.3 THEN 'L2' ELSE 'L3' END AS tier FROM s"""
)
def significance(spark, sf):
    out = scored(spark, sf)
    return out.select(
        "id", F.round("frequency", 6).alias("frequency"), F.round("salience", 6).alias("salience"), "importance",
        F.round("significance", 6).alias("significance"), "tier",
    )


def scored(spark, sf):
    rows = memory(spark, sf).select(
        "id", "trust_score", "created_at", F.col("memory_type").alias("kind"),
        (1 + F.col("id") % 10).alias("importance"), (F.col("id") % 5).alias("contradictions"),
    )
    return curation.score(rows, curation.access_counts(audit(spark, sf), EVENTS_NOW), EVENTS_NOW)


@query(
    f"""WITH {M}, s AS (SELECT id, trust_score AS sig, id % 3 = 0 AS recalled, CASE id % 4 WHEN 0 THEN 'L0' WHEN 1 THEN 'L1' WHEN 2 THEN 'L2' ELSE 'L3' END AS tier,
  greatest(0, floor(({NOW} - created_epoch) / 86400.0)) AS days, id % 7 = 0 AS pinned FROM memory)
 SELECT id, CASE WHEN recalled AND tier = 'L2' AND sig >= 0.6 THEN 'L1' WHEN recalled AND tier = 'L1' AND sig >= 0.8 THEN 'L0'
  WHEN tier = 'L1' AND sig < 0.6 AND days > 30 THEN 'L2' WHEN tier = 'L2' AND sig < 0.5 AND sig < 0.3 AND days > 180 THEN 'L3'
  WHEN tier = 'L0' AND days > 1 AND NOT pinned THEN 'L1' ELSE tier END AS next_tier FROM s"""
)
def tier_moves(spark, sf):
    tier = F.element_at(F.array(*[F.lit(x) for x in ("L0", "L1", "L2", "L3")]), (F.col("id") % 4 + 1).cast("int"))
    days = tr.whole_days(F.col("created_at"), NOW)
    return memory(spark, sf).select(
        "id",
        curation.next_tier(tier, F.col("trust_score"), days, days, days > 1, F.col("id") % 7 == 0, F.col("id") % 3 == 0).alias("next_tier"),
    )


@query(
    f"""WITH {M}, e AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS id, event_id AS seq, event_type AS t FROM events),
 f AS (SELECT id, arg_max(t, seq) FILTER (t IN ('view', 'click')) AS imp, arg_max(t, seq) FILTER (t IN ('error', 'purchase')) AS arc FROM e GROUP BY 1)
 SELECT m.id, coalesce(imp = 'view', false) AS important, coalesce(arc = 'error', false) AS archived FROM memory m LEFT JOIN f USING (id)"""
)
def user_marks(spark, sf):
    """Events as user marks; the last of each pair decides."""
    kind = F.col("action")
    marks = audit(spark, sf).select(
        F.col("memory_id").alias("id"), F.col("id").alias("seq"), F.lit(None).cast("timestamp").alias("until"),
        F.when(kind == "searched", "mark-important").when(kind == "created", "unmark-important")
        .when(kind == "conflict_flagged", "archive").when(kind == "purchase", "restore").alias("mark"),
    )
    return curation.apply_marks(memory(spark, sf), marks, EVENTS_NOW).select("id", "important", "archived")


@query(
    f"""WITH {M} SELECT id FROM memory WHERE created_epoch >= 1672531200 AND created_epoch < 1688169600"""
)
def date_range_export(spark, sf):
    return curation.export_range(
        memory(spark, sf), datetime(2023, 1, 1, tzinfo=timezone.utc), datetime(2023, 7, 1, tzinfo=timezone.utc)
    ).select("id")


@query(
    f"""WITH {M} SELECT id, CASE WHEN id % 5 = 0 THEN 'held' WHEN id % 17 = 0 THEN 'hazardous-candidate' ELSE 'production-candidate' END AS stage FROM memory"""
)
def hazard_route(spark, sf):
    return memory(spark, sf).select(
        "id", curation.hazard_route(F.col("id") % 17 == 0, F.col("id") % 5 != 0).alias("stage")
    )


@query(
    f"""WITH {M}, h AS (SELECT source_agent AS query_id, id, CASE WHEN trust_hundredths % 4 = 0 THEN 'L0' WHEN trust_hundredths % 4 = 1 THEN 'L1'
   WHEN trust_hundredths % 4 = 2 THEN 'L2' ELSE 'L3' END AS tier, {EFF} * (0.5 + (id % 50) / 100.0) AS conf, created_epoch FROM memory),
 b AS (SELECT query_id, max(conf) FILTER (tier = 'L0') AS hot, max(conf) FILTER (tier IN ('L0', 'L1')) AS warm FROM h GROUP BY 1),
 k AS (SELECT h.* FROM h JOIN b USING (query_id) WHERE tier = 'L0' OR (tier = 'L1' AND NOT coalesce(hot > 0.9, false))
  OR (tier = 'L2' AND NOT coalesce(hot > 0.9, false) AND NOT coalesce(warm > 0.7, false) AND floor(({NOW} - created_epoch) / 86400.0) <= 365)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY conf DESC, id) AS n FROM k)
 SELECT query_id, id, tier FROM r WHERE n <= 10"""
)
def tiered_recall(spark, sf):
    rows = memory(spark, sf)
    tier = F.element_at(F.array(*[F.lit(x) for x in ("L0", "L1", "L2", "L3")]), (F.col("trust_hundredths") % 4 + 1).cast("int"))
    conf = tr.effective_trust(F.col("trust_score"), F.col("created_at"), NOW) * (0.5 + F.col("id") % 50 / 100.0)
    hits = rows.select(F.col("source_agent").alias("query_id"), "id", tier.alias("tier"), conf.alias("confidence"), "created_at")
    return curation.tiered_recall(hits, 10, NOW).select("query_id", "id", "tier")
