"""Text screening, classification and tokens as native regex Columns.

Java regexes are prefixed with flags that give them the reference semantics:
U (Unicode \\w and \\b), d (only \\n ends a line), i where case is ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CONFIRMED_TRUST, FLAGGED_CEILING

# --- Fixed values: patterns, word lists and lookup tables that define results. ---
INJECTION_PATTERNS = (
    r"ignore\s+(previous|above|prior|all|instructions|everything)",
    r"^\s*system\s*:",
    r"(you are|act as|pretend to be|roleplay as)\s+\w",
    r"\[SYSTEM\]\s*:",
    r"\[INSTRUCTION\]\s*:",
    r"\[ADMIN\]\s*:",
    r"\[CRITICAL\]\s*:",
    r"\badmin\s+mode",
    r"\b(bypass|override)\b[^.!?]{0,30}\b(your|its)\b",
    r"disregard\s+(previous|above|prior|all)",
)
# A lower-case literal contained in every match of the patterns above.
INJECTION_HINTS = (
    "ignore", "system", "you are", "act as", "pretend to be", "roleplay as", "[instruction]",
    "[admin]", "[critical]", "admin", "bypass", "override", "disregard",
)
SQL_PATTERNS = (
    r"\bDROP\s+(TABLE|DATABASE|SCHEMA)",
    r"\bDELETE\s+(?:FROM)?",
    r"\bTRUNCATE",
    r"\bALTER\s+TABLE",
    r"\bUNION\s+(?:ALL\s+)?SELECT",
    r"\bEXEC\s*\(",
    r"--\s+",
    r";\s*\w+\s*(?:SELECT|DROP|DELETE|INSERT|UPDATE|TRUNCATE)",
    r"/\*.*?\*/",
    r"\(\s*SELECT",
)
SQL_KEYWORDS = ("UNION", "DROP", "DELETE", "INSERT", "UPDATE", "EXEC", "CALL", "PRAGMA")
AFFINITY_PATTERNS = {
    "prefer": r"\b(prefer|like|love|enjoy|want)\s+(.*?)(?:\s+over|\s+more|\.|\,|$)",
    "dislike": r"\b(hate|dislike|don't?\s+like|avoid|detest)\s+(.*?)(?:\.|,|$)",
    "identity": r"\b(am|'m|is)\s+(?:a\s+)?(\w+)(?:\s+person)?(?:\s+.*)?(?:\.|,|$)",
    "ability": r"\b(can|cannot|can't|able to|unable to)\s+(.*?)(?:\.|,|$)",
}
TRANSIENT = (
    r"\b(currently|right now|today i|working on|remind me|don't forget|will be|going to"
    r"|planning to|thinking about|notes from session|in progress)\b"
)
PERMANENT = (
    r"\b(always|never|i prefer|i like|i dislike|i hate|i am|i'm a|my name|i work as"
    r"|i specialize)\b"
)
PREFERENCE = r"\b(prefer|like|love|enjoy|hate|dislike|don't like|avoid)\b"
FIRST_PERSON = r"\b(i am|i'm|my|i have|i've|i do|i don't)\b"
TYPE_WEIGHTS = {
    "identity": 1.0,
    "preference": 0.9,
    "procedural": 0.8,
    "semantic": 0.7,
    "episodic": 0.5,
    "transient": 0.2,
}
STOP_WORDS = (
    "the a an and or but in on at to for of with is are was were be been have has had do does did"
    " will would could should may might shall can this that these those it its i me my we our you"
    " your he she they them his her their what which who how when where why not no yes just also"
    " very more some any all get got from by up out if so than then"
).split()
TOOL_WORDS = (
    "python postgres postgresql pgvector docker redis kafka ollama openai anthropic claude discord"
    " slack github mcp asyncpg alembic fastapi pydantic typescript javascript react nextjs"
).split()
GAZETTEER = {
    "PostgreSQL": "technology",
    "Postgres": "technology",
    "pgvector": "technology",
    "Python": "technology",
    "Docker": "technology",
    "Redis": "technology",
    "SQLite": "technology",
    "DuckDB": "technology",
    "Ollama": "technology",
    "FastAPI": "technology",
    "NetSuite": "organization",
    "Anthropic": "organization",
}
SECURITY_PATH_WORDS = (
    "security threat attack defense exploit inject vulnerability cve pentest adversarial poison"
    " jailbreak bypass override lessons-security audit"
).split()
CODE_EXTENSIONS = (".py", ".js", ".ts", ".sh", ".sql", ".go", ".rs")
WEB_PHRASES = ("according to", "from the web")

ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e\u034f"
CONFUSABLES = {
    # Cyrillic lower, Cyrillic upper, Greek
    "аеорсхуіѕјԁ": "aeopcxyisjd",
    "АВЕКМНОРСТХІЅ": "ABEKMHOPCTXIS",
    "οαεικνρτυ": "oaeikvptu",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": (
        "ABEZHIKMNOPTYX"
    ),
}
# Characters outside this class may change under NFKC: precomposed Latin, Greek and
# Cyrillic letters and common punctuation are stable as long as nothing combines.
_NFKC_STABLE = (
    "\u0000-\u007f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131"
    "\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f"
    "\u2010\u2012-\u2016\u2018-\u201e\u2022\u20ac"
)
_ANY_CASE = "(?iUd)"


def any_case(pattern: str) -> str:
    return _ANY_CASE + pattern


def cased(pattern: str) -> str:
    return "(?Ud)" + pattern


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times inside one expression."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


# --- screening ---


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def detection_form(text: Column) -> Column:
    """Fold zero-width, compatibility and confusable characters. Detection only.

    NFKC has no built-in; only texts with characters it could change reach the Arrow UDF,
    the others cross as NULL. Plain ASCII needs no folding at all.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    bare = F.when(ascii_only, text).otherwise(F.regexp_replace(text, f"[{ZERO_WIDTH}]", ""))
    odd = F.when(~ascii_only & bare.rlike(f"[^{_NFKC_STABLE}]"), bare)
    folded = F.coalesce(_nfkc(odd), bare)
    return F.when(ascii_only, text).otherwise(
        F.translate(folded, "".join(CONFUSABLES), "".join(CONFUSABLES.values()))
    )


def _any_of(patterns: tuple[str, ...]) -> str:
    return any_case("|".join(f"(?:{p})" for p in patterns))


def folded_case(text: Column) -> Column:
    """Lower case with the letters that match an ASCII letter when case is ignored."""
    return F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik"))


def injection_flag(text: Column) -> Column:
    """Any pattern hit. A literal every pattern needs is looked for first, as a substring."""

    def judged(form: Column) -> Column:
        def hinted(low: Column) -> Column:
            hint = F.lit(False)
            for word in INJECTION_HINTS:
                hint = hint | F.contains(low, F.lit(word))
            return hint

        return let(folded_case(form), hinted) & form.rlike(_any_of(INJECTION_PATTERNS))

    return let(detection_form(text), judged)


def injection_hits(text: Column) -> Column:
    """Indexes of the patterns that match, for explanations."""
    form = detection_form(text)
    hits = [F.when(form.rlike(any_case(p)), F.lit(i)) for i, p in enumerate(INJECTION_PATTERNS)]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def sql_danger(text: Column) -> Column:
    return text.rlike(_any_of(SQL_PATTERNS))


def sql_blocked(text: Column) -> Column:
    """NULL when the query text is acceptable, else the first reason."""
    words = F.when(
        F.coalesce(text, F.lit("")) == "", F.lit("empty query")
    ).when(sql_danger(text), F.lit("dangerous pattern"))
    for word in SQL_KEYWORDS:
        words = words.when(F.upper(text).rlike(cased(rf"\b{word}\b")), F.lit(f"keyword {word}"))
    return words


def sanitise(
    content: Column, trust: Column, content_class: Column, max_chars: int | None = None, flagged: Column | None = None
) -> dict[str, Column]:
    """Content, flag and override reason. Trust is the source trust.

    The whole text is screened and kept. With `max_chars` the kept text is cut there, after the
    whole of it was screened. `flagged` is the flag, where it is known already.
    """
    kept = content if max_chars is None else F.substring(content, 1, max_chars)
    flag = injection_flag(content) if flagged is None else flagged
    exempt = flag & (trust >= CONFIRMED_TRUST) & (content_class == "security-doc")
    reason = F.when(
        exempt,
        F.format_string(
            "authoritative-%s: source_trust=%.2f qualifies for trust preservation",
            content_class,
            trust.cast("double"),
        ),
    )
    return {"content": kept, "flagged": flag, "override_reason": reason}


def flagged_trust(trust: Column, flagged: Column, override_reason: Column) -> Column:
    capped = F.least(trust, F.lit(FLAGGED_CEILING))
    return F.when(flagged & override_reason.isNull(), capped).otherwise(trust)


# --- affinity ---


def affinity(text: Column, kind: str) -> Column:
    """(verb, object) pairs in order of appearance."""
    pattern = F.lit(any_case(AFFINITY_PATTERNS[kind]))
    verbs = F.regexp_extract_all(text, pattern, F.lit(1))
    objects = F.regexp_extract_all(text, pattern, F.lit(2))
    return F.arrays_zip(verbs.alias("verb"), objects.alias("object"))


def affinity_objects(text: Column, kind: str) -> Column:
    """Distinct lower-cased objects."""
    pattern = F.lit(any_case(AFFINITY_PATTERNS[kind]))
    return F.array_distinct(
        F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda x: F.lower(x))
    )


# --- submission heuristics ---


def durability(content: Column, memory_type: Column) -> Column:
    return (
        F.when(memory_type == "transient", F.lit("transient"))
        .when(memory_type == "identity", F.lit("permanent"))
        .when(content.rlike(any_case(TRANSIENT)), F.lit("transient"))
        .when(content.rlike(any_case(PERMANENT)), F.lit("permanent"))
        .otherwise(F.lit("durable"))
    )


def importance(content: Column, memory_type: Column, trust: Column) -> Column:
    # The products of weights are rounded decimals: 0.4 * 0.9 as doubles is above 0.36, which lifts a sum of 0.85 over the threshold.
    weight = F.lit(0.2)
    for name, value in TYPE_WEIGHTS.items():
        weight = F.when(memory_type == name, F.lit(round(0.40 * value, 4))).otherwise(weight)
    length = F.least(F.lit(1.0), F.length(content) / 500)
    return F.lit(0.40) * trust + weight + F.lit(0.20) * length


def urgency(durability_: Column, importance_: Column) -> Column:
    return (
        F.when(
            durability_ == "transient",
            F.when(importance_ > 0.7, F.lit("high")).otherwise(F.lit("low")),
        )
        .when((durability_ == "permanent") & (importance_ > 0.8), F.lit("high"))
        .when(importance_ > 0.85, F.lit("high"))
        .otherwise(F.lit("medium"))
    )


def corrected_type(content: Column, memory_type: Column) -> Column:
    return (
        F.when(
            (memory_type == "episodic") & content.rlike(any_case(PREFERENCE)), F.lit("preference")
        )
        .when(
            (memory_type == "semantic") & content.rlike(any_case(FIRST_PERSON)), F.lit("identity")
        )
        .otherwise(memory_type)
    )


def calibrated_trust(trust: Column, durability_: Column) -> Column:
    return F.when((durability_ == "transient") & (trust >= 0.9), F.lit(0.7)).otherwise(trust)


def encoding(content: Column) -> Column:
    return F.when(F.length(content) > 2000, F.lit("hybrid")).otherwise(F.lit("raw"))


def route(distance: Column, durability_: Column, importance_: Column, **at: float) -> dict[str, Column]:
    """Status, merge strategy, review flag and rejection reason from the nearest distance."""
    from ..schema import DEDUP_MERGE, DEDUP_REJECT, DEDUP_REVIEW

    reject = at.get("reject", DEDUP_REJECT)
    merge = at.get("merge", DEDUP_MERGE)
    review = at.get("review", DEDUP_REVIEW)
    far = F.coalesce(distance, F.lit(float("inf")))
    dull = (durability_ == "transient") & (importance_ < 0.35)
    return {
        "status": F.when(far < reject, F.lit("rejected"))
        .when(far < merge, F.lit("merged"))
        .when(dull, F.lit("rejected"))
        .otherwise(F.lit("approved")),
        "merge_strategy": F.when((far >= reject) & (far < merge), F.lit("append")),
        "requires_review": (far >= merge) & (far < review),
        "has_duplicate": far < review,
        "rejection_reason": F.when(far < reject, F.lit("exact duplicate")).when(
            (far >= merge) & dull, F.lit("transient low-importance content")
        ),
    }


def keyword_tokens(content: Column) -> Column:
    """Lower-case ASCII words of five letters or more, stop words removed, in text order."""
    words = F.regexp_extract_all(
        F.lower(content), F.lit(cased(r"(\b[a-zA-Z]{5,}\b)")), F.lit(1)
    )
    return F.filter(words, lambda w: ~w.isin(*[w for w in STOP_WORDS if len(w) >= 5]))


def inbox_entities(
    content: Column, extra: dict[str, list[str]] | None = None, per_kind: int | None = None
) -> dict[str, Column]:
    """People, tools and projects in order of first mention.

    `extra` adds names to a kind, found as whole words in any case and given as listed, after the
    others. `per_kind` keeps only the first so many of a kind.
    """
    people_pattern = F.lit(cased(r"@(\w+)|(?<![A-Z])([A-Z][a-z]+\s[A-Z][a-z]+)"))
    people = F.zip_with(
        F.regexp_extract_all(content, people_pattern, F.lit(1)),
        F.regexp_extract_all(content, people_pattern, F.lit(2)),
        lambda handle, name: F.concat(handle, name),
    )
    tools = F.regexp_extract_all(
        F.lower(content), F.lit(cased(rf"\b({'|'.join(TOOL_WORDS)})\b")), F.lit(1)
    )
    projects = F.regexp_extract_all(
        content, F.lit(cased(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b")), F.lit(1)
    )
    found = {"people": people, "tools": tools, "projects": projects}
    for kind, names in (extra or {}).items():
        listed = [F.when(content.rlike(any_case(rf"\b{re.escape(n)}\b")), F.lit(n)) for n in names]
        if listed:
            found[kind] = F.concat(found[kind], F.filter(F.array(*listed), lambda x: x.isNotNull()))
    distinct = {kind: F.array_distinct(names) for kind, names in found.items()}
    return distinct if per_kind is None else {k: F.slice(v, 1, per_kind) for k, v in distinct.items()}


def inferred_class(content: Column, declared: Column, source_agent: Column) -> Column:
    """Agent content of the default class that looks web-sourced becomes untrusted."""
    webby = content.rlike(any_case("https?://"))
    for phrase in WEB_PHRASES:
        webby = webby | F.lower(content).contains(phrase)
    hit = source_agent.isNotNull() & (declared == "general") & webby
    return F.when(hit, F.lit("external-untrusted")).otherwise(declared)


def path_class(path: Column) -> Column:
    lowered = F.lower(path)
    secure = F.lit(False)
    for word in SECURITY_PATH_WORDS:
        secure = secure | lowered.contains(word)
    code = F.lit(False)
    for ext in CODE_EXTENSIONS:
        code = code | lowered.endswith(ext)
    return (
        F.when(secure, F.lit("security-doc"))
        .when(code, F.lit("code-sample"))
        .otherwise(F.lit("general"))
    )


def path_type(path: Column, type_map: dict[str, str], default: str = "semantic") -> Column:
    """First needle contained in the path decides, in map order."""
    out = F.lit(default)
    for needle, name in reversed(list(type_map.items())):
        out = F.when(F.contains(F.lower(path), F.lit(needle.lower())), F.lit(name)).otherwise(out)
    return out


# --- hashes and similarity ---


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def submission_hash(content: Column) -> Column:
    """Hash of the text lower-cased with whitespace collapsed; not comparable to content_hash."""
    return F.sha2(F.regexp_replace(strip(F.lower(content)), r"(?U)\s+", " "), 256)


def word_set(text: Column) -> Column:
    words = F.split(F.lower(text), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def jaccard(words_a: Column, words_b: Column) -> Column:
    # A lambda's argument is computed once; a shared expression in a branch is computed at each use.
    both = F.array(F.size(F.array_intersect(words_a, words_b)))
    ratio = F.transform(both, lambda n: n / (F.size(words_a) + F.size(words_b) - n))[0]
    return F.when((F.size(words_a) == 0) | (F.size(words_b) == 0), F.lit(0.0)).otherwise(ratio)


# --- entities ---

PERSON = r"(\b[A-Z][A-Za-z.]*(?:\s+[A-Z][a-z]+){1,2}\b)"
URL_HOST = r"https?://([^/\s:]+)"
EMAIL_DOMAIN = r"[\w.+-]+@([\w-]+(?:\.[\w-]+)+)"


def clean_host(host: Column) -> Column:
    return F.regexp_replace(strip(F.lower(host)), r"^www\.", "")


def entity_structs(content: Column, extra: dict[str, str] | None = None) -> Column:
    """Candidate entities in precedence order: gazetteer, hosts, e-mail domains, persons.

    Persons sharing a token with a matched gazetteer name are left out.
    """
    names = {**GAZETTEER, **(extra or {})}

    def struct(name: Column, kind: str, confidence: float) -> Column:
        return F.struct(
            name.alias("name"), F.lit(kind).alias("entity_type"), F.lit(confidence).alias("confidence")
        )

    def listed(folded: Column) -> Column:
        """Gazetteer hits; a plain substring test spares most texts the word regex."""
        hits = [
            F.when(
                F.contains(folded, F.lit(name.lower()))
                & content.rlike(any_case(rf"\b{re.escape(name)}\b")),
                struct(F.lit(name), kind, 0.9),
            )
            for name, kind in names.items()
        ]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    def all_of(pattern: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(content, F.lit(cased(pattern)), F.lit(1)))

    def persons(claimed: Column) -> Column:
        free = F.filter(
            all_of(PERSON),
            lambda p: ~F.arrays_overlap(
                F.array_append(F.split(F.lower(p), r"(?U)\s+"), F.lower(p)), claimed
            ),
        )
        return F.transform(free, lambda p: struct(strip(p), "person", 0.7))

    hosts = F.transform(all_of(URL_HOST), lambda h: struct(clean_host(h), "organization", 0.8))
    mails = F.transform(all_of(EMAIL_DOMAIN), lambda h: struct(clean_host(h), "organization", 0.7))
    found = let(
        let(folded_case(content), listed),
        lambda matched: F.concat(
            matched,
            hosts,
            mails,
            let(F.transform(matched, lambda x: F.lower(x["name"])), persons),
        ),
    )
    return F.filter(found, lambda x: x["name"] != "")
