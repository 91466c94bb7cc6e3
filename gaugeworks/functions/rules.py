"""An ordered inclusion contract: one definition gives predicate, reason and counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INCLUDED = "included"

# The potency curation contract.
CURATED_TYPES = ("IC50", "Ki", "Kd", "EC50")
MIN_CONFIDENCE = 7
TYPE_REASON = "non_curated_standard_type"
VALUE_REASON = "missing_or_unconvertible_nm_value"
PCHEMBL_REASON = "missing_pchembl_value"
CONFIDENCE_REASON = "low_confidence_score"
VALIDITY_REASON = "data_validity_comment_present"
RELATION_REASON = "ambiguous_standard_relation"


@dataclass(frozen=True)
class Rule:
    """``passes`` builds the condition a good row meets; NULL counts as not met."""

    reason: str
    passes: Callable[[], Column]


@dataclass(frozen=True)
class RuleSet:
    """Rules in order. Metrics and checks take the types and the confidence bound from here."""

    rules: tuple[Rule, ...]
    types: tuple[str, ...] = CURATED_TYPES
    min_confidence: int = MIN_CONFIDENCE

    def predicate(self) -> Column:
        """All rules met. A plain conjunction, so each part can reach the file scan."""
        condition = self.rules[0].passes()
        for rule in self.rules[1:]:
            condition = condition & rule.passes()
        return condition

    def reason(self, unknown_passes: Iterable[str] = ()) -> Column:
        """The first rule a row fails, or ``included``.

        ``unknown_passes`` names rules for which an undecided (NULL) condition
        is let through, the way ``x NOT IN (...)`` does for a NULL ``x``.
        """
        lenient = set(unknown_passes)
        outcome: Column | None = None
        for rule in self.rules:
            met = F.coalesce(rule.passes(), F.lit(rule.reason in lenient))
            outcome = (F if outcome is None else outcome).when(~met, F.lit(rule.reason))
        return outcome.otherwise(F.lit(INCLUDED))

    @property
    def reasons(self) -> tuple[str, ...]:
        return tuple(rule.reason for rule in self.rules)


def potency_rules(
    types: Iterable[str] = CURATED_TYPES, min_confidence: int = MIN_CONFIDENCE
) -> RuleSet:
    types = list(types)
    return RuleSet(
        (
            Rule(TYPE_REASON, lambda: F.col("standard_type").isin(types)),
            Rule(VALUE_REASON, lambda: F.col("standard_value_nm").isNotNull()),
            Rule(PCHEMBL_REASON, lambda: F.col("pchembl_value").isNotNull()),
            Rule(CONFIDENCE_REASON, lambda: F.col("confidence_score") >= min_confidence),
            Rule(VALIDITY_REASON, lambda: F.col("data_validity_comment").isNull()),
            Rule(
                RELATION_REASON,
                lambda: F.col("standard_relation").isNull() | (F.col("standard_relation") == "="),
            ),
        ),
        tuple(types),
        min_confidence,
    )
