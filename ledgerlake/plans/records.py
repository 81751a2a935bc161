"""Trust, reports, screening, classification, admission and loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import trust as tr
from ..operators import conflict, flood, hooks, ingest, insights, reports, sketches
from ..sources import archive, markdown
from ..streaming.common import fresh_path
from .registry import query
from .views import A, EFF, EVENTS_NOW, M, NOW, audit, events, memory, table

DAYS = f"greatest(0, floor(({NOW} - created_epoch) / 86400.0))"
CREATED = "make_timestamp(created_epoch * 1000000::BIGINT)"


# --- trust ---


@query(f"WITH {M} SELECT id, CAST({DAYS} AS BIGINT) AS days, round({EFF}, 9) AS effective FROM memory")
def trust_decay(spark, sf):
    days = tr.whole_days(F.col("created_at"), NOW)
    return memory(spark, sf).select(
        "id", days.alias("days"), F.round(tr.decay(F.col("trust_score"), days), 9).alias("effective")
    )


@query(
    f"""WITH {M}, r AS (SELECT id, memory_type, trust_score, CAST({DAYS} AS BIGINT) AS age_days, {EFF} AS eff, content
  FROM memory WHERE valid_until_epoch IS NULL AND trust_score >= 0.7 AND created_epoch < {NOW} - 90 * 86400)
 SELECT id, memory_type, round_even(trust_score, 3) AS stored_trust, round_even(eff, 3) AS effective_trust,
  age_days, left(content, 60) AS content FROM r WHERE eff < trust_score * 0.8"""
)
def decay_report(spark, sf):
    return reports.decay_report(memory(spark, sf), NOW)


@query(
    f"""WITH {M} SELECT id, trust_score >= 0.9 AS confirmed, trust_score >= 0.4 AND trust_score < 0.9 AS agent_tier,
 trust_score < 0.5 AS review, greatest(0.3, least(1.0, trust_score * 1.5 - 0.3)) AS clamped,
 CASE WHEN trust_score * 1.5 - 0.6 < 0 THEN 'trust below 0.0' WHEN trust_score * 1.5 - 0.45 > 1.0
  THEN 'trust above 1.0' END AS problem FROM memory"""
)
def trust_tiers(spark, sf):
    t = F.col("trust_score")
    odd = F.when(t * 1.5 - 0.6 < 0, t * 1.5 - 0.6).otherwise(t * 1.5 - 0.45)
    return memory(spark, sf).select(
        "id", tr.is_confirmed(t).alias("confirmed"), tr.is_agent_tier(t).alias("agent_tier"),
        tr.needs_review(t).alias("review"), tr.clamp(t * 1.5 - 0.3).alias("clamped"),
        tr.trust_error(odd).alias("problem"),
    )


@query(
    f"""WITH {M} SELECT id, round(greatest(0.3, trust_score - (1 - trust_score) * (1 - least(1.0, (id % 25) * 0.05))), 9) AS low,
 round(least(1.0, trust_score + (1 - trust_score) * (1 - least(1.0, (id % 25) * 0.05))), 9) AS high FROM memory"""
)
def trust_interval(spark, sf):
    span = tr.confidence_interval(F.col("trust_score"), F.col("id") % 25)
    rows = memory(spark, sf).select("id", span.alias("s"))
    return rows.select("id", F.round("s.low", 9).alias("low"), F.round("s.high", 9).alias("high"))


@query(
    f"""WITH {M} SELECT id, CASE WHEN id % 5 = 0 THEN 0.9 WHEN id % 2 = 0 OR id % 3 = 0 THEN 1.0
  WHEN id % 7 = 0 THEN 0.6 ELSE 0.3 END AS inferred,
 round(least(1.0, trust_score + 0.1), 9) AS boosted,
 round(greatest(0.3, trust_score - CASE project WHEN 'en' THEN 0.15 WHEN 'de' THEN 0.3 ELSE 0.05 END), 9) AS penalised
 FROM memory"""
)
def trust_adjust(spark, sf):
    n, t = F.col("id"), F.col("trust_score")
    severity = F.when(F.col("project") == "en", "medium").when(F.col("project") == "de", "high").otherwise("odd")
    return memory(spark, sf).select(
        "id",
        tr.infer_trust(n % 2 == 0, n % 3 == 0, n % 7 == 0, n % 5 == 0).alias("inferred"),
        F.round(tr.boost(t), 9).alias("boosted"), F.round(tr.penalise(t, severity), 9).alias("penalised"),
    )


@query(
    f"""WITH {M} SELECT a.id, a.trust_score >= 0.9 AND a.memory_type = b.memory_type AS amends
 FROM memory a JOIN memory b ON b.id = a.id - 6"""
)
def amendments(spark, sf):
    """Each record judged as an amendment of the one six ids before it."""
    new = memory(spark, sf).select("id", "trust_score", "memory_type")
    old = new.select((F.col("id") + 6).alias("id"), F.col("memory_type").alias("old_type"))
    return new.join(old, "id").select(
        "id", tr.is_amendment(F.col("trust_score"), F.col("old_type"), F.col("memory_type")).alias("amends")
    )


# --- counts and reports ---


@query(
    f"""WITH {M} SELECT memory_type, content_class, count(*) AS n FROM memory
 WHERE valid_until_epoch IS NULL GROUP BY 1, 2"""
)
def count_by_type_class(spark, sf):
    return reports.counts(memory(spark, sf).filter("valid_until IS NULL"), ["memory_type", "content_class"])


@query(
    f"""WITH {M} SELECT memory_type, content_class, count(*) AS n FROM memory
 WHERE valid_until_epoch IS NULL GROUP BY CUBE (memory_type, content_class)"""
)
def count_cube(spark, sf):
    return reports.counts(memory(spark, sf).filter("valid_until IS NULL"), ["memory_type", "content_class"], cube=True)


@query(
    f"""WITH {M} SELECT count(*) AS total, count(*) FILTER (trust_score >= 0.8) AS high_trust,
 count(*) FILTER (trust_score >= 0.5 AND trust_score < 0.8) AS medium_trust,
 count(*) FILTER (trust_score < 0.5) AS low_trust,
 CAST(round(sum(trust_hundredths) / (count(*) * 100.0), 3) AS DOUBLE) AS avg_trust FROM memory WHERE valid_until_epoch IS NULL"""
)
def trust_distribution(spark, sf):
    live = memory(spark, sf).filter("valid_until IS NULL")
    return reports.trust_distribution(live.withColumn("trust_score", F.col("trust_score").cast("decimal(3,2)")))


# Events seen as submissions and as the conflict queue.
INBOX_SQL = """
SELECT event_id AS id, CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 WHEN 0 THEN 'pending'
  WHEN 1 THEN 'held' WHEN 2 THEN 'approved' WHEN 3 THEN 'merged' ELSE 'rejected' END AS status, ts AS processed_at
FROM events"""
QUEUE_SQL = """
SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS memory_id,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' ELSE 'done' END AS status,
  ts AS claimed_at FROM events"""


def inbox(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint") % 5
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "held", "approved", "merged", "rejected")]), (k + 1).cast("int"))
    return events(spark, sf).select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("processed_at"), "user_id", "value")


def queue(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "view", "processing").otherwise("done")
    return events(spark, sf).select(
        F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("bigint").alias("memory_id"),
        status.alias("status"), F.col("ts").alias("claimed_at"),
        F.lit(None).cast("timestamp").alias("finished_at"), F.col("ts").alias("enqueued_at"),
    )


STUCK = f"status = 'failed' OR (status = 'processing' AND claimed_at < make_timestamp(({EVENTS_NOW} - 3600) * 1000000::BIGINT))"


@query(
    f"""WITH {M}, i AS ({INBOX_SQL}), q AS ({QUEUE_SQL})
 SELECT 'active_memories' AS metric, count(*) AS value FROM memory WHERE valid_until_epoch IS NULL
 UNION ALL SELECT 'inbox_pending', count(*) FROM i WHERE status = 'pending'
 UNION ALL SELECT 'inbox_held', count(*) FROM i WHERE status = 'held'
 UNION ALL SELECT 'stuck_conflicts', count(*) FROM q WHERE {STUCK}"""
)
def health_summary(spark, sf):
    return reports.health_summary(memory(spark, sf), inbox(spark, sf), queue(spark, sf), EVENTS_NOW)


@query(
    """WITH c AS (SELECT quality = 1 AS w, toxic = 0 AS g, doc_id % 17 AS ms FROM labels),
 n AS (SELECT sum(ms) AS total, max(ms) AS latency_max, count(*) FILTER (w AND g) AS tp, count(*) FILTER (NOT w AND NOT g) AS tn,
  count(*) FILTER (NOT w AND g) AS fp, count(*) FILTER (w AND NOT g) AS fn FROM c)
 SELECT tp AS true_positive, tn AS true_negative, fp AS false_positive, fn AS false_negative,
  CASE WHEN tp + fp > 0 THEN round_even(tp / (tp + fp), 4) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN round_even(tp / (tp + fn), 4) ELSE 0.0 END AS recall,
  round_even((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round_even(total / (tp + tn + fp + fn), 4) AS latency_mean, latency_max FROM n"""
)
def classifier_metrics(spark, sf):
    return reports.classifier_metrics(table(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 17)


@query(
    """SELECT doc_id AS id, CASE WHEN toxic = 0 THEN 'false_positive' ELSE 'false_negative' END AS error
 FROM labels WHERE (quality = 1) <> (toxic = 0)"""
)
def classifier_errors(spark, sf):
    return reports.misjudged(table(spark, sf, "labels"), "doc_id", F.col("quality") == 1, F.col("toxic") == 0)


@query(
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS m FROM events GROUP BY 1)
 SELECT event_type, n, round(m, 6) AS mean,
  v[least(CAST(floor(n * 0.5) AS BIGINT), n - 1) + 1] AS p50,
  v[least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1] AS p95 FROM s"""
)
def latency_percentiles(spark, sf):
    return reports.nearest_rank(events(spark, sf), "value", ["event_type"], {"p50": 0.5, "p95": 0.95})


@query(
    """WITH s AS (SELECT list_sort(list(value)) AS v, count(*) AS n, avg(value) AS m FROM events)
 SELECT n, round(m, 6) AS mean, v[least(CAST(floor(n * 0.5) AS BIGINT), n - 1) + 1] AS p50,
  v[least(CAST(floor(n * 0.99) AS BIGINT), n - 1) + 1] AS p99 FROM s"""
)
def latency_overall(spark, sf):
    return reports.nearest_rank(events(spark, sf), "value", [], {"p50": 0.5, "p99": 0.99})


@query(
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS distinct_in_bound, true AS p50_in_bound, true AS p95_in_bound FROM events GROUP BY 1"""
)
def sketched_percentiles(spark, sf):
    """Users and percentiles by event type from stored daily sketches, held against the exact counts and ranks."""
    rows, path, ps = events(spark, sf), fresh_path(spark, "sketches"), {"p50": 0.5, "p95": 0.95}
    sketches.store(sketches.daily(rows, "ts", ["event_type"], "user_id", "value"), path)
    near = sketches.merged(sketches.stored(spark, path), ["event_type"], ps)
    exact = rows.join(F.broadcast(near.select("event_type", *ps)), "event_type").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.count("value").alias("valued"),
        *[F.count_if(F.col("value") < F.col(p)).alias(f"below_{p}") for p in ps], *[F.count_if(F.col("value") <= F.col(p)).alias(f"upto_{p}") for p in ps],
    )
    off = F.abs(F.col("distinct_items") - F.col("users")) <= sketches.DISTINCT_ERROR * F.col("users")
    # Equal values share their ranks: one of them has to be within the bound.
    ranked = [
        ((F.col(f"below_{p}") / F.col("valued") <= share + sketches.RANK_ERROR) & (F.col(f"upto_{p}") / F.col("valued") >= share - sketches.RANK_ERROR)).alias(f"{p}_in_bound")
        for p, share in ps.items()
    ]
    return near.join(exact, "event_type").select("event_type", "n", "users", off.alias("distinct_in_bound"), *ranked)


# --- screening and classification ---

RE2_INJECTION = "|".join(
    f"(?:{p})"
    for p in (
        r"ignore\s+(previous|above|prior|all|instructions|everything)", r"^\s*system\s*:",
        r"(you are|act as|pretend to be|roleplay as)\s+[\p{L}\p{M}\p{N}_]", r"\[SYSTEM\]\s*:",
        r"\[INSTRUCTION\]\s*:", r"\[ADMIN\]\s*:", r"\[CRITICAL\]\s*:", r"(?:^|[^\p{L}\p{N}_])admin\s+mode",
        r"(?:^|[^\p{L}\p{N}_])(bypass|override)(?:[^\p{L}\p{N}_.!?][^.!?]{0,29})?[^\p{L}\p{N}_](your|its)(?:$|[^\p{L}\p{N}_])",
        r"disregard\s+(previous|above|prior|all)",
    )
)


def _ci(pattern: str) -> str:
    """Whole-word, case-insensitive alternation for the other engine."""
    words = pattern.replace(r"\b(", "").removesuffix(r")\b").replace("'", "''")
    return r"(?i)(?:^|[^\p{L}\p{M}\p{N}_])(?:" + words + r")(?:$|[^\p{L}\p{M}\p{N}_])"


@query(
    f"""WITH {M}, f AS (SELECT id, content_class, trust_score, content AS kept FROM memory),
 g AS (SELECT *, regexp_matches(kept, '(?i){RE2_INJECTION}') AS flagged FROM f),
 h AS (SELECT *, CASE WHEN flagged AND trust_score >= 0.9 AND content_class = 'security-doc' THEN
   printf('authoritative-%s: source_trust=%.2f qualifies for trust preservation', content_class, trust_score) END AS reason FROM g)
 SELECT id, length(kept) AS n_chars, flagged, reason,
  CASE WHEN flagged AND reason IS NULL THEN least(trust_score, 0.3) ELSE trust_score END AS trust_after FROM h"""
)
def injection_flags(spark, sf):
    clean = tx.sanitise(F.col("content"), F.col("trust_score"), F.col("content_class"))
    rows = memory(spark, sf).select(
        "id", "trust_score", F.length(clean["content"]).cast("bigint").alias("n_chars"),
        clean["flagged"].alias("flagged"), clean["override_reason"].alias("reason"),
    )
    return rows.select(
        "id", "n_chars", "flagged", "reason",
        tx.flagged_trust(F.col("trust_score"), F.col("flagged"), F.col("reason")).alias("trust_after"),
    )


@query(
    """SELECT page_id AS id, regexp_matches(html, '(?is)DROP\\s+(TABLE|DATABASE|SCHEMA)|DELETE\\s+|TRUNCATE|ALTER\\s+TABLE|UNION\\s+(ALL\\s+)?SELECT|EXEC\\s*\\(|--\\s+|/\\*[^\\n]*?\\*/|\\(\\s*SELECT') AS danger
 FROM pages"""
)
def sql_pattern_flags(spark, sf):
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), tx.sql_danger(F.col("html")).alias("danger")
    )


SAID = "concat('I like ', source_agent, ' more. We avoid ', project, ', they say ', content)"


@query(
    f"""WITH {M}, s AS (SELECT id, {SAID} AS said FROM memory),
 p AS (SELECT id, regexp_extract_all(said, '(?i)\\b(prefer|like|love|enjoy|want)\\s+(.*?)(?:\\s+over|\\s+more|\\.|,|$)', 1) AS v,
  regexp_extract_all(said, '(?i)\\b(prefer|like|love|enjoy|want)\\s+(.*?)(?:\\s+over|\\s+more|\\.|,|$)', 2) AS o FROM s),
 d AS (SELECT id, regexp_extract_all(said, '(?i)\\b(hate|dislike|don''t?\\s+like|avoid|detest)\\s+(.*?)(?:\\.|,|$)', 1) AS v,
  regexp_extract_all(said, '(?i)\\b(hate|dislike|don''t?\\s+like|avoid|detest)\\s+(.*?)(?:\\.|,|$)', 2) AS o FROM s)
 SELECT id, unnest(v) AS verb, unnest(o) AS object FROM p UNION ALL SELECT id, unnest(v), unnest(o) FROM d"""
)
def affinity_terms(spark, sf):
    """Preference and dislike pairs of every record, each opened by a statement of both kinds."""
    said = memory(spark, sf).withColumn("said", F.expr(SAID))
    rows = said.select(
        "id", F.explode(F.concat(tx.affinity(F.col("said"), "prefer"), tx.affinity(F.col("said"), "dislike"))).alias("a")
    )
    return rows.select("id", "a.verb", "a.object")


@query(
    f"""WITH {M}, s AS (SELECT id, 'he is a ' || source_agent || ', she cannot ' || project || '.' AS said FROM memory)
 SELECT id, 'is' AS verb, regexp_extract(said, 'is a (\\w+)', 1) AS object FROM s UNION ALL
 SELECT id, 'cannot', regexp_extract(said, 'cannot (\\w+)', 1) FROM s"""
)
def affinity_traits(spark, sf):
    """What statements about a record's source and language say of identity and ability."""
    said = memory(spark, sf).withColumn("said", F.expr("concat('he is a ', source_agent, ', she cannot ', project, '.')"))
    identity, ability = tx.affinity(F.col("said"), "identity"), tx.affinity(F.col("said"), "ability")
    return said.select("id", F.explode(F.concat(identity, ability)).alias("a")).select("id", "a.verb", "a.object")


@query(
    f"""SELECT page_id AS id, CASE {" ".join(f"WHEN page_id % 9 = {k} THEN 'keyword {w}'" for k, w in enumerate(tx.SQL_KEYWORDS) if w != "DELETE")}
 WHEN page_id % 9 = {tx.SQL_KEYWORDS.index("DELETE")} THEN 'dangerous pattern' ELSE NULL END AS reason FROM pages"""
)
def sql_keywords(spark, sf):
    """Query texts, each made of a page's url and one word: the blocked words and a harmless one."""
    words = F.array(*[F.lit(w) for w in (*tx.SQL_KEYWORDS, "SELECTION")])
    # The url is reduced to letters so that nothing but the word decides.
    text = F.concat_ws(" ", F.regexp_replace("url", r"[^a-z]+", "_"), F.lower(F.get(words, F.col("page_id").cast("int") % 9)), F.lit("x"))
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), tx.sql_blocked(text).alias("reason"))


DURABILITY = (
    "CASE WHEN memory_type = 'transient' THEN 'transient' WHEN memory_type = 'identity' THEN 'permanent'"
    f" WHEN regexp_matches(content, '{_ci(tx.TRANSIENT)}') THEN 'transient'"
    f" WHEN regexp_matches(content, '{_ci(tx.PERMANENT)}') THEN 'permanent' ELSE 'durable' END"
)
IMPORTANCE = (
    "(0.4 * trust_score + 0.4 * CASE memory_type WHEN 'identity' THEN 1.0 WHEN 'preference' THEN 0.9"
    " WHEN 'procedural' THEN 0.8 WHEN 'semantic' THEN 0.7 WHEN 'episodic' THEN 0.5 ELSE 0.2 END"
    " + 0.2 * least(1.0, length(content) / 500.0))"
)


@query(
    f"""WITH {M} SELECT id, {DURABILITY} AS durability,
 CASE WHEN memory_type = 'episodic' AND regexp_matches(content, '{_ci(tx.PREFERENCE)}') THEN 'preference'
  WHEN memory_type = 'semantic' AND regexp_matches(content, '{_ci(tx.FIRST_PERSON)}') THEN 'identity'
  ELSE memory_type END AS suggested_type,
 CASE WHEN {DURABILITY} = 'transient' AND trust_score >= 0.9 THEN 0.7 ELSE trust_score END AS suggested_trust,
 CASE WHEN length(content) > 2000 THEN 'hybrid' ELSE 'raw' END AS encoding FROM memory"""
)
def classify_durability(spark, sf):
    c, t = F.col("content"), F.col("memory_type")
    rows = memory(spark, sf).withColumn("durability", tx.durability(c, t))
    return rows.select(
        "id", "durability", tx.corrected_type(c, t).alias("suggested_type"),
        tx.calibrated_trust(F.col("trust_score"), F.col("durability")).alias("suggested_trust"),
        tx.encoding(c).alias("encoding"),
    )


@query(
    f"""WITH {M}, r AS (SELECT id, {DURABILITY} AS durability, {IMPORTANCE} AS imp FROM memory)
 SELECT id, round(imp, 6) AS importance, CASE WHEN durability = 'transient' THEN CASE WHEN imp > 0.7 THEN 'high' ELSE 'low' END
  WHEN durability = 'permanent' AND imp > 0.8 THEN 'high' WHEN imp > 0.85 THEN 'high' ELSE 'medium' END AS urgency FROM r"""
)
def score_importance(spark, sf):
    c, t = F.col("content"), F.col("memory_type")
    value = tx.importance(c, t, F.col("trust_score"))
    return memory(spark, sf).select(
        "id", F.round(value, 6).alias("importance"), tx.urgency(tx.durability(c, t), value).alias("urgency")
    )


KEYWORDS_SQL = f"""
WITH {M}, w AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM
  (SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS ws FROM memory)),
 k AS (SELECT id, word, count(*) AS n, min(pos) AS first FROM w
  WHERE regexp_full_match(word, '[a-z]{{5,}}') AND word NOT IN ({",".join(f"'{x}'" for x in tx.STOP_WORDS)}) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS rk FROM k)
SELECT id, string_agg(word, ',' ORDER BY rk) AS keywords FROM r WHERE rk <= 20 GROUP BY 1
"""


@query(KEYWORDS_SQL)
def keywords_top20(spark, sf):
    return ingest.top_keywords(memory(spark, sf)).select("id", F.array_join("keywords", ",").alias("keywords"))


def _firsts(sql: str) -> str:
    """The distinct items of a list in order, joined."""
    return f"array_to_string(list_filter({sql}, lambda x, i: list_position({sql}, x) = i), ',')"


@query(
    f"""WITH {M}, s AS (SELECT id, concat('by @', source_agent, ' and Ann Lee, ', source_agent, ' in DataLake: ', content) AS said FROM memory),
 p AS (SELECT id, list_transform(regexp_extract_all(said, '@[\\p{{L}}\\p{{N}}_]+|(?:^|[^A-Z])[A-Z][a-z]+\\s[A-Z][a-z]+'), lambda x: regexp_replace(x, '^[^A-Za-z]', '')) AS people,
  regexp_extract_all(lower(said), '\\b({"|".join(tx.TOOL_WORDS)})\\b', 1) AS tools,
  regexp_extract_all(said, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1) AS projects FROM s)
 SELECT id, {_firsts("people")} AS people, {_firsts("tools")} AS tools, concat_ws(',', nullif({_firsts("projects")}, ''), 'the lake') AS projects FROM p"""
)
def inbox_entities(spark, sf):
    """Names in every record, opened by a statement that holds some; one listed name is added."""
    said = memory(spark, sf).withColumn("said", F.expr("concat('by @', source_agent, ' and Ann Lee, ', source_agent, ' in DataLake: ', content)"))
    # The full stop keeps the last word of the record and the first of the statement from being read as one name.
    found = tx.inbox_entities(F.concat("said", F.lit(". The LAKE.")), {"projects": ["the lake", "the sea"]})
    return said.select("id", *[F.array_join(v, ",").alias(k) for k, v in found.items()])


DIST = "list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(
    f"""WITH {M}, c AS (SELECT m.id, e.embedding FROM memory m JOIN embeddings e ON e.vec_id = m.id WHERE valid_until_epoch IS NULL),
 s AS (SELECT m.*, e.embedding FROM memory m JOIN embeddings e ON e.vec_id = m.id WHERE valid_until_epoch IS NOT NULL),
 p AS (SELECT a.id, b.id AS dup, round(greatest({DIST}, 0), 9) AS d FROM s a CROSS JOIN c b),
 n AS (SELECT id, dup, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, dup) AS k FROM p) WHERE k = 1),
 r AS (SELECT s.id, {DURABILITY} AS du, {IMPORTANCE} AS imp FROM s)
 SELECT id, CASE WHEN d < 0.6 THEN 'rejected' WHEN d < 0.65 THEN 'merged'
   WHEN du = 'transient' AND imp < 0.35 THEN 'rejected' ELSE 'approved' END AS status,
  CASE WHEN d < 0.7 THEN dup END AS near_duplicate_of, round_even(d, 4) AS duplicate_distance,
  CASE WHEN d >= 0.6 AND d < 0.65 THEN 'append' END AS merge_strategy, d >= 0.65 AND d < 0.7 AS requires_review,
  CASE WHEN d < 0.6 THEN 'exact duplicate' WHEN d >= 0.65 AND du = 'transient' AND imp < 0.35
   THEN 'transient low-importance content' END AS rejection_reason
 FROM n JOIN r USING (id)"""
)
def route_decisions(spark, sf):
    """Retired records as submissions; wider thresholds, since the test vectors lie far apart."""
    from ..operators.knn import nearest
    from .views import vectors

    both = vectors(spark, sf)
    new = both.filter("valid_until IS NOT NULL")
    corpus = both.filter("valid_until IS NULL").select("id", F.col("embedding").alias("vector"))
    close = nearest(new.select(F.col("id").alias("probe_id"), F.col("embedding").alias("vector")), corpus, 1)
    close = close.select(F.col("probe_id").alias("id"), F.col("id").alias("duplicate_id"), "distance")
    sub = new.select("id", "content", F.col("memory_type").alias("caller_type"), F.col("trust_score").alias("caller_trust"))
    return ingest.classify(sub, close, reject=0.6, merge=0.65, review=0.7).select(
        "id", "status", "near_duplicate_of", "duplicate_distance", "merge_strategy", "requires_review", "rejection_reason"
    )


# --- admission ---


@query(
    """SELECT page_id AS id, CASE WHEN page_id % 5 <> 0 AND page_id % 4 <> 0 AND (regexp_matches(html, '(?i)https?://')
  OR contains(lower(html), 'according to') OR contains(lower(html), 'from the web')) THEN 'external-untrusted'
  WHEN page_id % 4 = 0 THEN 'code-sample' ELSE 'general' END AS content_class FROM pages"""
)
def infer_class(spark, sf):
    n = F.col("page_id")
    declared = F.when(n % 4 == 0, F.lit("code-sample")).otherwise(F.lit("general"))
    agent = F.when(n % 5 != 0, F.lit("agent"))
    return table(spark, sf, "pages").select(
        n.alias("id"), tx.inferred_class(F.col("html"), declared, agent).alias("content_class")
    )


@query(
    f"""WITH {M} SELECT id, least(trust_score, 0.6) AS trust, trust_score > 0.6 AS was_clamped,
 CASE WHEN id % 3 = 0 THEN 'general' ELSE content_class END AS resolved FROM memory"""
)
def trust_ceiling(spark, sf):
    c = ingest.clamped_trust(F.col("trust_score"))
    given = F.when(F.col("id") % 3 == 0, F.lit("general"))
    return memory(spark, sf).select(
        "id", c["trust"].alias("trust"), c["was_clamped"].alias("was_clamped"),
        ingest.resolved_class(given, F.col("metadata")).alias("resolved"),
    )


@query(
    f"""WITH {M} SELECT id, CASE WHEN id % 11 = 0 THEN 'content must be non-empty' WHEN id % 7 = 0 THEN 'unknown memory_type'
 WHEN id % 5 = 0 THEN 'actor is required' WHEN trust_score * 1.3 > 1.0 THEN 'trust above 1.0'
 WHEN id % 3 = 0 THEN 'wrong embedding dimensions' END AS reason FROM memory"""
)
def validate_writes(spark, sf):
    n = F.col("id")
    reason = ingest.write_error(
        F.when(n % 11 == 0, F.lit(" \n")).otherwise(F.col("content")),
        F.when(n % 7 == 0, F.lit("dream")).otherwise(F.col("memory_type")),
        F.when(n % 5 == 0, F.lit("")).otherwise(F.lit("agent")),
        F.col("trust_score") * 1.3,
        F.when(n % 3 == 0, F.lit(768)).otherwise(F.lit(64)), 64,
    )
    return memory(spark, sf).select("id", reason.alias("reason"))


@query(
    f"""WITH {M}, k AS (SELECT id, unnest(json_keys(metadata)) AS key FROM memory)
 SELECT id, string_agg(key, ',' ORDER BY key) AS keys FROM k
 WHERE key NOT IN ('injection_flagged', 'insight_type', 'source_trust_min', 'trust_override_reason') GROUP BY 1"""
)
def metadata_strip(spark, sf):
    kept = F.json_object_keys(ingest.scrub_metadata(F.col("metadata")))
    return memory(spark, sf).select("id", F.array_join(F.array_sort(kept), ",").alias("keys"))


@query(
    """WITH s AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN concat(substr(md5(text), 1, 8), '-', substr(md5(text), 9, 4), '-',
  substr(md5(text), 13, 4), '-', substr(md5(text), 17, 4), '-', substr(md5(text), 21, 12)) ELSE concat('session ', role) END AS s FROM conversations)
 SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN s END AS session_id, CASE WHEN conv_id % 2 = 1 THEN s END AS session_label FROM s"""
)
def session_id_split(spark, sf):
    raw = F.when(F.col("conv_id") % 2 == 0, F.upper(F.md5("text"))).otherwise(F.concat(F.lit("session "), "role"))
    out = ingest.split_session(raw)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", out["session_id"].alias("session_id"), out["session_label"].alias("session_label")
    )


@query(
    """SELECT event_id, prior, low = 1 AND prior >= 3 AS held FROM (SELECT event_id, low, CAST(win - peers AS BIGINT) AS prior FROM (
 SELECT event_id, low,
  sum(low) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS win,
  sum(low) OVER (PARTITION BY user_id, us ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS peers
 FROM (SELECT event_id, user_id, epoch_us(ts) AS us, CASE WHEN value <= 150 THEN 1 ELSE 0 END AS low FROM events) x) y)"""
)
def flood_admission(spark, sf):
    out = flood.flood_admission(
        events(spark, sf), "user_id", "ts", "event_id", F.col("value") <= 150, 3, 86400
    )
    return out.select("event_id", "prior", "held")


@query(
    f"""WITH {A} SELECT memory_id, count(*) AS flags FROM audit WHERE action = 'conflict_flagged'
 AND timestamp > make_timestamp(({EVENTS_NOW} - 7 * 86400) * 1000000::BIGINT) GROUP BY 1 HAVING count(*) >= 3"""
)
def repeat_conflicts(spark, sf):
    return conflict.repeat_conflicts(audit(spark, sf), EVENTS_NOW)


@query(
    f"""WITH i AS ({INBOX_SQL}) SELECT id, CASE WHEN status <> 'held' THEN status WHEN id % 4 = 0 THEN 'approved'
  WHEN id % 4 = 1 THEN 'rejected' WHEN id % 4 = 2 THEN 'pending' ELSE 'held' END AS status,
 status = 'held' AND id % 4 IN (0, 1) AS done FROM i"""
)
def inbox_review(spark, sf):
    """Reviewer decisions on held submissions."""
    rows = inbox(spark, sf).withColumn("retry_count", F.lit(1)).withColumn("processed_at", F.lit(None).cast("timestamp"))
    act = F.element_at(F.array(F.lit("approve"), F.lit("reject"), F.lit("retry")), (F.col("id") % 4 + 1).cast("int"))
    decisions = rows.filter("id % 4 < 3").select("id", act.alias("action"), F.lit("seen").alias("reason"))
    from datetime import datetime

    return ingest.review_actions(rows, decisions, datetime(2024, 1, 31)).select(
        "id", "status", F.col("processed_at").isNotNull().alias("done")
    )


@query(
    """SELECT page_id AS id, md5(left(html, 120)) AS preview FROM pages WHERE page_id % 3 = 0 ORDER BY length(url), page_id LIMIT 25"""
)
def held_submissions(spark, sf):
    """Pages as submissions, a third of them held; the length of the address stands for time."""
    rows = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.col("html").alias("content"), F.length("url").alias("submitted_at"),
        F.when(F.col("page_id") % 3 == 0, "held").otherwise("pending").alias("status"),
    )
    return ingest.held_list(rows, 25).select("id", F.md5("content").alias("preview"))


@query(
    f"""WITH {M}, s AS (SELECT id, trust_score, regexp_matches(content, '(?i){RE2_INJECTION}') AS rx, id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS model FROM memory),
 e AS (SELECT *, NOT rx AND trust_score < 0.8 AND model AS hit FROM s)
 SELECT id, rx OR hit AS flagged, hit AS model_hit, CASE WHEN hit THEN least(trust_score, 0.3) ELSE trust_score END AS trust_after,
  CASE WHEN rx THEN 'regex_injection' WHEN hit THEN 'llm_classifier' END AS review_reason,
  CASE WHEN rx OR hit THEN 'held' ELSE 'approved' END AS status FROM e"""
)
def model_screening(spark, sf):
    """Verdicts of a second pass, here the stored toxic labels, on regex-clean, low-trust records; hits are held."""
    rows = memory(spark, sf).select("id", "content", "trust_score").withColumn(
        "injection_flagged", tx.injection_flag(F.col("content"))
    )
    verdicts = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") == 1).alias("model_flagged"))
    done = ingest.second_pass(rows.withColumn("regex_flagged", F.col("injection_flagged")), verdicts)
    done = done.withColumn("any_flagged", F.col("injection_flagged")).withColumn("status", F.lit("approved"))
    held = ingest.hold_flagged(done.withColumn("review_reason", F.lit(None).cast("string")).withColumn("requires_review", F.lit(False)))
    return held.select(
        "id", F.col("injection_flagged").alias("flagged"), F.col("llm_injection_flagged").alias("model_hit"),
        F.col("trust_score").alias("trust_after"), "review_reason", "status",
    )


@query(
    f"""WITH q AS ({QUEUE_SQL}) SELECT id, CASE WHEN status = 'failed' AND memory_id % 4 + 1 >= 3 THEN 'failed'
  WHEN status = 'failed' THEN 'pending' ELSE status END AS next_status,
 status = 'processing' AND claimed_at < make_timestamp(({EVENTS_NOW} - 3600) * 1000000::BIGINT) AS reclaimable FROM q"""
)
def retry_policy(spark, sf):
    step = ingest.after_failure(F.col("status"), F.col("memory_id") % 4, "failed")
    return queue(spark, sf).select(
        "id", F.when(F.col("status") == "failed", step["status"]).otherwise(F.col("status")).alias("next_status"),
        ingest.reclaimable(F.col("status"), F.col("claimed_at"), EVENTS_NOW).alias("reclaimable"),
    )


@query(
    f"""WITH i AS ({INBOX_SQL}) SELECT id, status FROM i WHERE NOT (status IN ('approved', 'merged', 'rejected')
 AND processed_at < make_timestamp(({EVENTS_NOW} - 10 * 86400) * 1000000::BIGINT))"""
)
def inbox_ttl(spark, sf):
    return archive.retained_inbox(inbox(spark, sf), EVENTS_NOW, 10).select("id", "status")


@query(
    """SELECT conv_id, count(*) AS n_turns,
 md5(string_agg(concat(role, ': ', text), chr(10) ORDER BY turn)) AS content_md5 FROM conversations GROUP BY 1"""
)
def session_summaries(spark, sf):
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    out = ingest.session_summaries(table(spark, sf, "conversations"), "conv_id", "turn", line)
    return out.select(F.col("session").alias("conv_id"), "n_turns", F.md5("content").alias("content_md5"))


@query(
    f"""WITH {M} SELECT id FROM memory WHERE valid_until_epoch IS NULL AND id % 3 <> 0 ORDER BY created_epoch, id LIMIT 10"""
)
def stale_embedding_preview(spark, sf):
    model = F.when(F.col("id") % 3 == 0, F.lit("new")).otherwise(F.lit("old"))
    return hooks.stale_preview(memory(spark, sf).withColumn("embedding_model", model), "new")


@query(
    f"""WITH {M} SELECT id, 'local/hash' AS embedding_model, 16 AS embedding_dimensions,
 list_transform(range(0, 16), lambda i: (('0x' || substr(sha256(lower(content)), 2 * i + 1, 2))::INT - 128) / 128.0::DOUBLE) AS embedding
 FROM memory WHERE valid_until_epoch IS NULL"""
)
def re_embed(spark, sf):
    rows = memory(spark, sf).withColumn("embedding_model", F.lit("old"))
    return hooks.re_embed(rows, hooks.hash_embedder(16)).drop("embedding_error").withColumn("embedding", F.col("embedding").cast("array<double>"))


# --- loading ---


@query(
    """WITH t AS (SELECT doc_id, concat('doc', doc_id) AS stem, string_split_regex(concat('## ', replace(text, chr(10), chr(10) || '## ')), '(?m)^##\\s+') AS p FROM documents),
 r AS (SELECT doc_id, stem, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS pos FROM t),
 s AS (SELECT *, regexp_replace(regexp_replace(part, '^\\s+', ''), '\\s+$', '') AS body FROM r WHERE pos > 0)
 SELECT doc_id, CAST(pos AS INTEGER) AS pos, concat(stem, ' › ', trim(string_split(part, chr(10))[1])) AS title,
  md5(concat('## ', body)) AS body_md5 FROM s WHERE length(body) >= 80"""
)
def section_chunks(spark, sf):
    """Documents with every line turned into a section."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("## "), F.replace("text", F.lit("\n"), F.lit("\n## "))).alias("text")
    )
    out = markdown.section_chunks(docs, stem=F.concat(F.lit("doc"), F.col("doc_id")))
    return out.select("doc_id", "pos", "title", F.md5("body").alias("body_md5"))


@query(
    f"""WITH RECURSIVE raw AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^---\\n(?s:.*?)\\n---\\n', ''), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM documents),
 u AS (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS p, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS k FROM raw),
 q AS (SELECT * FROM (SELECT doc_id, k, regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS p FROM u) WHERE length(p) >= {markdown.MIN_CHARS}),
 s AS (SELECT doc_id, k, string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM q WHERE length(p) > {markdown.MAX_CHARS}),
 f AS (SELECT doc_id, k, 1 AS i, ss, ss[1] AS o, 0 AS n FROM s UNION ALL
  SELECT doc_id, k, i + 1, ss, CASE WHEN length(o) + length(ss[i + 1]) + 1 > {markdown.MAX_CHARS} THEN ss[i + 1] ELSE o || ' ' || ss[i + 1] END,
   n + CAST(length(o) + length(ss[i + 1]) + 1 > {markdown.MAX_CHARS} AS INT) FROM f WHERE i < len(ss)),
 c AS (SELECT doc_id, k, n, arg_max(o, i) AS chunk FROM f GROUP BY 1, 2, 3 UNION ALL SELECT doc_id, k, 0, p FROM q WHERE length(p) <= {markdown.MAX_CHARS})
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, n) - 1 AS pos, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM c"""
)
def paragraph_chunks(spark, sf):
    out = markdown.paragraph_chunks(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "pos", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query(
    """SELECT page_id, CASE WHEN contains(lower(url), '/en/') THEN 'semantic' WHEN contains(lower(url), 'example.com') THEN 'procedural'
  WHEN contains(lower(url), '/fr/') THEN 'episodic' ELSE 'preference' END AS memory_type,
 CASE WHEN regexp_matches(lower(url), 'security|threat|attack|defense|exploit|inject|vulnerability|cve|pentest|adversarial|poison|jailbreak|bypass|override|audit') THEN 'security-doc'
  WHEN regexp_matches(lower(url), '\\.(py|js|ts|sh|sql|go|rs)$') THEN 'code-sample' ELSE 'general' END AS content_class FROM pages"""
)
def path_labels(spark, sf):
    types = {"/EN/": "semantic", "example.com": "procedural", "/fr/": "episodic"}
    return table(spark, sf, "pages").select(
        "page_id", tx.path_type(F.col("url"), types, "preference").alias("memory_type"),
        tx.path_class(F.col("url")).alias("content_class"),
    )


@query(
    """WITH h AS (SELECT doc_id, source, sha256(text) AS content_hash FROM documents),
 f AS (SELECT content_hash, min(struct_pack(source := source, doc_id := doc_id)) AS k FROM h GROUP BY 1),
 b AS (SELECT sha256(text) AS content_hash FROM benchmark)
 SELECT h.doc_id, h.content_hash FROM h JOIN f ON f.content_hash = h.content_hash AND f.k.doc_id = h.doc_id
 WHERE h.content_hash NOT IN (SELECT content_hash FROM b)"""
)
def content_hash_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("content"))
    stored = table(spark, sf, "benchmark").select(tx.content_hash(F.col("text")).alias("content_hash"))
    return markdown.first_copies(docs, ["source", "doc_id"], stored=stored).select("doc_id", "content_hash")


@query(
    f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY sha256(content) ORDER BY id) AS n FROM memory)
 SELECT memory_type, count(*) AS chunks, count(*) FILTER (n = 1) AS loaded, count(*) FILTER (n > 1) AS deduped,
  count(*) FILTER (n = 1 AND id % 17 = 0) AS flagged FROM r GROUP BY 1"""
)
def load_report(spark, sf):
    rows = memory(spark, sf)
    return markdown.load_report(rows, markdown.first_copies(rows, ["id"]), flagged=F.col("id") % 17 == 0)


@query(
    """SELECT doc_id, sha256(text) AS record_hash, sha256(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\\s+', ''), '\\s+$', ''), '\\s+', ' ', 'g')) AS submission_hash
 FROM documents"""
)
def text_hashes(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.content_hash(F.col("text")).alias("record_hash"),
        tx.submission_hash(F.col("text")).alias("submission_hash"),
    )


# --- scans ---


@query(
    f"""WITH {M}, {A} SELECT id FROM memory m WHERE valid_until_epoch IS NULL AND memory_type = 'procedural'
 AND NOT EXISTS (SELECT 1 FROM audit a WHERE a.memory_id = m.id AND action = 'searched'
   AND timestamp > make_timestamp(({EVENTS_NOW} - 10 * 86400) * 1000000::BIGINT))
 AND NOT EXISTS (SELECT 1 FROM audit a WHERE a.memory_id = m.id AND action = 'stale_flagged')"""
)
def stale_procedural(spark, sf):
    return insights.stale_procedures(memory(spark, sf), audit(spark, sf), EVENTS_NOW, 10).select("id")


@query(
    f"""WITH {M}, g AS (SELECT source_agent, count(*) AS cnt, avg(trust_score) AS avg_trust FROM memory
  WHERE valid_until_epoch IS NULL AND trust_score < 0.6 GROUP BY 1 HAVING count(*) <= 20)
 SELECT id, source_agent, cnt, round(avg_trust, 6) AS avg_trust FROM memory JOIN g USING (source_agent)
 WHERE valid_until_epoch IS NULL AND trust_score < 0.6"""
)
def weak_signal(spark, sf):
    out = insights.weak_signals(memory(spark, sf), "source_agent", 0.6, 20)
    return out.select("id", "source_agent", "cnt", F.round("avg_trust", 6).alias("avg_trust"))


@query(
    f"""WITH {A}, q AS ({QUEUE_SQL}) SELECT id, memory_id FROM q WHERE status = 'failed'
 AND claimed_at < make_timestamp(({EVENTS_NOW} - 24 * 3600) * 1000000::BIGINT)
 AND memory_id NOT IN (SELECT memory_id FROM audit WHERE action = 'purchase' AND actor = '8')"""
)
def stuck_conflicts(spark, sf):
    told = F.when((F.col("action") == "purchase") & (F.col("actor") == "8"), "contradiction_surfacing_needed")
    log = audit(spark, sf).withColumn("action", F.coalesce(told, "action"))
    return insights.stuck_to_surface(queue(spark, sf), log, EVENTS_NOW).select("id", "memory_id")


@query(
    f"""WITH {M} SELECT count(*) AS archived, count(DISTINCT strftime(make_timestamp(valid_until_epoch * 1000000::BIGINT), '%Y-%m')) AS months
 FROM memory WHERE valid_until_epoch < {NOW} - 90 * 86400 AND id % 5 <> 0"""
)
def cold_archive(spark, sf):
    """Archive twice over a store that already holds a part, then read the cold table back."""
    path = fresh_path(spark, "cold")
    rows = memory(spark, sf)
    first = rows.filter("id % 5 = 0").select("id")
    archive.write_cold(archive.archivable(rows, first, NOW), path)
    cold = spark.read.parquet(path)
    again = archive.archivable(rows, first.unionByName(cold.select("id")), NOW)
    return cold.unionByName(again.withColumn("month", F.lit(None)), allowMissingColumns=True).agg(
        F.count("*").alias("archived"), F.count_distinct("month").alias("months")
    )
