"""Trust arithmetic as Columns. `now` is always an argument, never the wall clock."""

from __future__ import annotations

from datetime import datetime, timezone
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CONFIRMED_TRUST, MAX_TRUST, MIN_TRUST

# Penalty by contradiction severity; salience half-life in days by kind.
PENALTIES = {"low": 0.05, "medium": 0.15, "high": 0.3}
HALF_LIFE_DAYS = {
    "procedural": 180,
    "factual": 365,
    "episodic": 90,
    "preference": 365,
    "decision": 365,
}


def now_micros(now: datetime | int | float) -> int:
    """Evaluation time as epoch microseconds; numbers are taken as epoch seconds."""
    if isinstance(now, datetime):
        aware = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
        return int(aware.timestamp() * 1_000_000)
    return int(now * 1_000_000)


def floor_div(value: Column, size: int) -> Column:
    """Whole-number floor division, exact for any bigint (no detour over doubles)."""
    step = F.lit(size).cast("bigint")
    number = value.cast("bigint")
    return F.call_function("div", number - F.pmod(number, step), step)


def half_even(value: Column, digits: int) -> Column:
    """Round the double itself, ties to even. `bround` rounds its shortest decimal text, which
    turns values just beside a tie into ties."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


#: Hundredths n from 0 to 100 where the double nearest to n + 0.5 of them is printed as the next one: it's a little above, or a tie of an odd n.
_TIES_UP = [n for n in range(101) if (Fraction((2 * n + 1) / 200), n % 2) > (Fraction(2 * n + 1, 200), 0)]


def two_places(value: Column) -> Column:
    """The double itself with two decimals, ties to even, as C prints it. Java's formatter rounds its shortest decimal
    text half up, so 0.495, which is a little below, becomes 0.50 there. Values outside 0 to 1 are left to the formatter."""

    def printed(x: Column) -> Column:
        def rounded(n: Column) -> Column:
            middle = (n * 2 + 1) / 200.0
            return n + ((x > middle) | ((x == middle) & n.isin(*_TIES_UP))).cast("int")

        cents = F.transform(F.array(F.floor(x * 100.0).cast("int")), rounded)[0]
        return F.when((x >= 0.0) & (x <= 1.0), F.format_string("%.2f", cents / 100.0)).otherwise(F.format_string("%.2f", x))

    return F.transform(F.array(value), printed)[0]


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(MIN_TRUST), F.least(F.lit(MAX_TRUST), score.cast("double")))


def trust_error(score: Column) -> Column:
    """NULL when valid, else the reason."""
    value = score.cast("double")
    return (
        F.when(value.isNull(), F.lit("trust must be numeric"))
        .when(value < 0.0, F.lit("trust below 0.0"))
        .when(value > 1.0, F.lit("trust above 1.0"))
    )


def is_confirmed(score: Column) -> Column:
    return score >= CONFIRMED_TRUST


def is_agent_tier(score: Column) -> Column:
    return (score >= 0.4) & (score < CONFIRMED_TRUST)


def needs_review(score: Column) -> Column:
    return score < 0.5


def whole_days(created_at: Column, now: datetime | int | float) -> Column:
    """Full 24-hour periods elapsed, never negative (not calendar days)."""
    micros = F.lit(now_micros(now)) - F.unix_micros(created_at.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(micros / F.lit(86_400_000_000)))


def decay(score: Column, days: Column, rate: float = 0.01) -> Column:
    value = score.cast("double")
    aged = F.greatest(F.lit(MIN_TRUST), value * F.pow(F.lit(1.0 - rate), days))
    return F.when(value >= CONFIRMED_TRUST, value).otherwise(aged)


def effective_trust(score: Column, created_at: Column, now: datetime | int | float) -> Column:
    """Read-time trust; a record without a creation time keeps its stored trust."""
    aged = decay(score, whole_days(created_at, now))
    return F.when(created_at.isNull(), score.cast("double")).otherwise(aged)


def confidence_interval(score: Column, updates: Column) -> Column:
    margin = (1.0 - score) * (1.0 - F.least(F.lit(1.0), updates * 0.05))
    return F.struct(
        F.greatest(F.lit(MIN_TRUST), score - margin).alias("low"),
        F.least(F.lit(MAX_TRUST), score + margin).alias("high"),
    )


def infer_trust(spoken: Column, typed: Column, proposed: Column, confirmed: Column) -> Column:
    return (
        F.when(confirmed, F.lit(0.9))
        .when(spoken | typed, F.lit(1.0))
        .when(proposed, F.lit(0.6))
        .otherwise(F.lit(0.3))
    )


def boost(score: Column, strength: float = 0.1) -> Column:
    return F.least(F.lit(MAX_TRUST), score + strength)


def penalise(score: Column, severity: Column) -> Column:
    amount = F.lit(PENALTIES["low"])
    for name in ("medium", "high"):
        amount = F.when(severity == name, F.lit(PENALTIES[name])).otherwise(amount)
    return F.greatest(F.lit(MIN_TRUST), score - amount)


def is_amendment(new_trust: Column, old_type: Column, new_type: Column) -> Column:
    return (new_trust >= CONFIRMED_TRUST) & old_type.eqNullSafe(new_type)


# --- curation scores (documented behaviour) ---


def frequency_score(accesses: Column, days_since: Column, cap: int = 100) -> Column:
    share = F.least(accesses, F.lit(cap)).cast("double") / F.lit(float(cap))
    recency = F.when(days_since <= 30, F.lit(1.0)).otherwise(F.lit(0.5))
    return F.when(accesses == 0, F.lit(0.0)).otherwise(share * recency)


def salience(base: Column, days: Column, kind: Column) -> Column:
    half = F.lit(180.0)
    for name, value in HALF_LIFE_DAYS.items():
        half = F.when(kind == name, F.lit(float(value))).otherwise(half)
    return base * F.pow(F.lit(0.5), days / half)


def adjusted_importance(marked: Column, contradictions: Column, trust: Column) -> Column:
    after = F.when(
        contradictions > 2, marked - F.least(marked - 1, contradictions)
    ).otherwise(marked)
    after = F.when(trust < 0.5, after - 2).otherwise(after)
    return F.greatest(F.lit(1), F.least(F.lit(10), after))


def significance(
    importance: Column, frequency: Column, salience_: Column, contradiction: Column
) -> Column:
    base = importance / 10.0 * 0.4 + frequency * 0.3 + salience_ * 0.3
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - contradiction * 0.2))


def tier_of(score: Column) -> Column:
    return (
        F.when(score >= 0.8, F.lit("L0"))
        .when(score >= 0.6, F.lit("L1"))
        .when(score >= 0.3, F.lit("L2"))
        .otherwise(F.lit("L3"))
    )
