"""Confidence decay in fixed-point integers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
FULL = 65_535

# Half-lives in days by record kind and source; None never decays.
HALF_LIFE_DAYS: dict[tuple[str, str], int | None] = {
    ("sem", "profile"): 730, ("sem", "observation"): 180, ("sem", "self_report"): 90, ("sem", "participant_report"): 90,
    ("sem", "document"): 365, ("sem", "registry"): 90, ("sem", "policy"): 730, ("sem", "external_authority"): 180,
    ("sem", "agent_instruction"): 730, ("sem", "librarian_assignment"): None, ("sem", "pending_verification"): 30,
    ("epi", "observation"): 90, ("epi", "self_report"): 30, ("epi", "participant_report"): 60,
}

# The largest confidence that a source may claim, of 65,535, and the record kinds it may state.
SOURCE_BOUNDS: dict[str, int] = {
    "observation": 65535, "policy": 65535, "librarian_assignment": 65535, "profile": 62258, "registry": 62258, "agent_instruction": 62258,
    "self_report": 58982, "document": 58982, "external_authority": 58982, "participant_report": 55705, "pending_verification": 39321,
}
SOURCE_ADMITS: dict[str, tuple[str, ...]] = {
    "profile": ("sem",), "document": ("sem",), "registry": ("sem",), "external_authority": ("sem",), "librarian_assignment": ("sem",),
    "observation": ("sem", "epi"), "self_report": ("sem", "epi"), "participant_report": ("epi",), "policy": ("pro",),
    "agent_instruction": ("sem", "pro"), "pending_verification": ("sem", "epi", "pro"),
}


def source_kind(name: Column) -> Column:
    """The kind of a source from its symbol's name; a name that isn't reserved is an observation."""
    return F.when(name.isin(*SOURCE_BOUNDS), name).otherwise(F.lit("observation"))


def divide(a: Column, b: Column) -> Column:
    """Integer division; all operands here are non-negative."""
    return F.call_function("div", a, b)


def _days(overrides) -> dict[tuple[str, str], int | None]:
    """Half-lives with overrides; an override of 0 days stands for no decay, unknown keys are ignored."""
    days = dict(HALF_LIFE_DAYS)
    for key, value in dict(overrides or {}).items():
        if value < 0:
            raise ValueError("a half-life is not negative")
        if key in days:
            days[key] = value or None
    return days


def half_lives(spark: SparkSession, overrides: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """(kind, source, half_life_ms)."""
    days = _days(overrides)
    rows = [(k, s, 0 if d is None else d * DAY_MS) for (k, s), d in days.items()]
    return spark.createDataFrame(rows, "kind string, source string, half_life_ms long")


def lookup(values: dict, key: Column, default=None) -> Column:
    """A small fixed table as a map literal: no join and no shuffle."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def half_life_ms(kind: str, source: Column, overrides=None) -> Column:
    if kind == "pro":
        return F.lit(0).cast("long")
    return lookup({s: (d or 0) * DAY_MS for (k, s), d in _days(overrides).items() if k == kind}, source).cast("long")


def _halves() -> Column:
    return F.array(*(F.lit(round(2 ** (-i / 256) * FULL)).cast("long") for i in range(256)))


def decay_factor(elapsed_ms: Column, half_life: Column) -> Column:
    """The share of 65,535 that is left after ``elapsed_ms``; all of it for a half-life of 0."""
    life = F.when(half_life > 0, half_life)
    steps = divide(F.least(elapsed_ms, F.lit((1 << 54) - 1)) * 256, life)
    whole = F.shiftright(steps, 8)
    cut = F.element_at(_halves(), (steps.bitwiseAND(F.lit(255)) + 1).cast("int"))
    left = F.call_function("shiftright", cut, F.least(whole, F.lit(16)).cast("int"))
    return F.when(half_life.isNull() | (half_life <= 0), F.lit(FULL).cast("long")).when(whole >= 16, F.lit(0).cast("long")).otherwise(left)


def effective_confidence(stored: Column, factor: Column, exempt: Column | None = None) -> Column:
    """Stored confidence times the factor, rounded; pinned and authoritative rows are exempt."""
    product = divide(stored.cast("long") * factor + 32_767, F.lit(FULL))
    return product if exempt is None else F.when(exempt, stored.cast("long")).otherwise(product)


# The least weight of a rule, and the days after which its weight is a 1/e of what it was.
ACTIVITY_FLOOR, ACTIVITY_DAYS = 0.3, 180


def activity_factor(last_fire: Column, created: Column, now: Column) -> Column:
    """Weight of a rule by its last firing; one that never fired counts from its creation."""
    days = (now - F.coalesce(last_fire, created)) / F.lit(float(DAY_MS))
    return F.greatest(F.lit(ACTIVITY_FLOOR), F.least(F.lit(1.0), F.exp(-days / ACTIVITY_DAYS)))
