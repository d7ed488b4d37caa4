"""Confidence of inferred rows from their parents' confidences, in fixed point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .decay import FULL, divide

#: Product-like methods take at most this many parents.
MOST_FACTORS = 8

# The fraction by which each method scales what it takes of its parents.
MIN_SCALES = {
    "majority_vote": (1, 1), "citation_link": (9, 10), "dominance_analysis": (3, 5), "entity_count": (4, 5), "interval_calc": (9, 10),
    "feedback_consolidation": (17, 20), "qualitative_inference": (1, 2),
}
PRODUCT_SCALES = {"architectural_chain": (1, 1), "provenance_chain": (1, 1), "analogy_inference": (7, 10)}
# Fixed values: (least parents, exact count wanted, odd count wanted) by method.
PARENT_RULES = {
    "direct_lookup": (1, True, False), "majority_vote": (3, False, True), "citation_link": (2, True, False), "analogy_inference": (2, True, False),
    "interval_calc": (2, True, False), "pattern_summarize": (2, False, False), "architectural_chain": (2, False, False),
    "dominance_analysis": (2, False, False), "provenance_chain": (2, False, False), "multi_source_consensus": (2, False, False),
    "conflict_reconciliation": (2, False, False), "entity_count": (1, False, False), "feedback_consolidation": (1, False, False),
    "qualitative_inference": (1, False, False),
}
# When superseded parents make an inferred row stale.
STALENESS_RULES = {
    **dict.fromkeys(
        ("direct_lookup", "majority_vote", "architectural_chain", "dominance_analysis", "feedback_consolidation", "qualitative_inference", "provenance_chain"),
        "any_parent",
    ),
    **dict.fromkeys(("citation_link", "analogy_inference", "interval_calc"), "either_endpoint"),
    "pattern_summarize": "over_half", "entity_count": "parent_count_changes", "multi_source_consensus": "fewer_than_two_remain",
    "conflict_reconciliation": "any_parent_or_new_conflict",
}


def multiply(a: Column, b: Column) -> Column:
    return divide(a * b + 32_767, F.lit(FULL))


def scale(value: Column, numerator: int, denominator: int) -> Column:
    return divide(value * numerator + denominator // 2, F.lit(denominator))


def _fold(parents: Column, step) -> Column:
    """A left fold that rounds at every step; the order of the parents matters."""
    return F.aggregate(parents, F.lit(FULL).cast("long"), step)


def min_of(parents: Column, numerator: int = 1, denominator: int = 1) -> Column:
    return scale(F.array_min(parents), numerator, denominator)


def max_of(parents: Column, numerator: int = 4, denominator: int = 5) -> Column:
    return scale(F.array_max(parents), numerator, denominator)


def product_of(parents: Column, numerator: int = 1, denominator: int = 1) -> Column:
    return F.when(F.size(parents) <= MOST_FACTORS, scale(_fold(parents, multiply), numerator, denominator))


def consensus_of(parents: Column) -> Column:
    """One minus the product of the complements."""
    return F.when(F.size(parents) <= MOST_FACTORS, FULL - _fold(parents, lambda acc, p: multiply(acc, FULL - p)))


def geometric_mean_root(values: list[int]) -> int:
    """Floor of the n-th root of the product, exactly."""
    product = 1
    for v in values:
        product *= v
    low, high = 0, FULL
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid ** len(values) <= product else (low, mid - 1)
    return low


@F.pandas_udf(LongType())
def _summarised(parents):
    def one(values):
        if values is None or not 0 < len(values) <= MOST_FACTORS:
            return None
        return (geometric_mean_root([int(v) for v in values]) * 4 + 2) // 5

    return parents.map(one).astype("Int64")


def pattern_summarize(parents: Column) -> Column:
    """4/5 of the geometric mean; eight factors need 128 bits, hence Python integers."""
    return _summarised(parents)


def inferred_confidence(method: Column, parents: Column) -> Column:
    """Confidence by method; null if the parents don't fit a product-like method."""
    out = F.when(method == "direct_lookup", F.element_at(parents, 1))
    for name, ratio in MIN_SCALES.items():
        out = out.when(method == name, min_of(parents, *ratio))
    for name, ratio in PRODUCT_SCALES.items():
        out = out.when(method == name, product_of(parents, *ratio))
    return out.when(method == "multi_source_consensus", consensus_of(parents)).when(method == "conflict_reconciliation", max_of(parents))


def parents_fit(method: Column, n: Column) -> Column:
    """Whether a row has as many parents as its method wants."""
    out = F.lit(False)
    for name, (least, exact, odd) in PARENT_RULES.items():
        rule = (n == least) if exact else (n >= least) & ((n % 2 == 1) if odd else F.lit(True))
        out = F.when(method == name, rule).otherwise(out)
    return out


def is_stale(method: Column, n_parents: Column, n_superseded: Column, count_changed: Column | None = None, new_conflict: Column | None = None) -> Column:
    """Whether an inferred row is stale, by its method's rule.

    ``count_changed``: whether the set that the parents stand for has gained or
    lost a member; a superseded parent is no longer a member, so that counts
    too. ``new_conflict``: whether a record in conflict came on the row's key.
    """
    changed, conflict = (F.lit(False) if c is None else F.coalesce(c, F.lit(False)) for c in (count_changed, new_conflict))
    tests = {
        "any_parent": n_superseded > 0, "either_endpoint": n_superseded > 0, "over_half": 2 * n_superseded > n_parents,
        "parent_count_changes": changed | (n_superseded > 0), "fewer_than_two_remain": n_parents - n_superseded < 2,
        "any_parent_or_new_conflict": (n_superseded > 0) | conflict,
    }
    out = F.lit(None).cast("boolean")
    for rule, test in tests.items():
        out = F.when(method.isin(*(m for m, r in STALENESS_RULES.items() if r == rule)), test).otherwise(out)
    return out
