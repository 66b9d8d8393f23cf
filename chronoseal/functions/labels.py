"""Labels, ids and decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import LABEL_VOCABULARIES

POSITIVE = "diagnosed"
NEGATIVE = "control"
NO_EVIDENCE = "no-evidence"
TERNARY = (POSITIVE, NEGATIVE, NO_EVIDENCE)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_user_id(c: Column | str) -> Column:
    """``" 12.0 "`` becomes ``"12"``; any other id is only trimmed."""
    return F.regexp_replace(F.trim(_col(c).cast("string")), r"^(\d+)\.0$", "$1")


def normalize_label(
    c: Column | str,
    vocabulary: str = "corpus",
    positive: str = POSITIVE,
    negative: str = NEGATIVE,
    strict: bool = False,
) -> Column:
    """Map a raw label to the two class names; NULL (or an error if ``strict``) when unknown."""
    yes, no = LABEL_VOCABULARIES[vocabulary]
    text = F.lower(F.trim(_col(c).cast("string")))
    mapped = F.when(text.isin(*yes), F.lit(positive)).when(text.isin(*no), F.lit(negative))
    if strict:
        mapped = mapped.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(text, F.lit("NULL")))).cast("string"))
    return mapped


def normalize_ternary_label(c: Column | str, strict: bool = False) -> Column:
    text = F.lower(F.trim(_col(c).cast("string")))
    mapped = (
        F.when(text == POSITIVE, F.lit(POSITIVE))
        .when(text == NEGATIVE, F.lit(NEGATIVE))
        .when(text.isin("no-evidence", "no_evidence", "no evidence"), F.lit(NO_EVIDENCE))
    )
    if strict:
        mapped = mapped.otherwise(F.raise_error(F.concat(F.lit("unknown ternary label: "), F.coalesce(text, F.lit("NULL")))).cast("string"))
    return mapped


def parse_boolean(c: Column | str) -> Column:
    """Only the texts ``true`` and ``false`` count; anything else is NULL."""
    return F.when(_col(c) == "true", F.lit(True)).when(_col(c) == "false", F.lit(False))


def decide(score: Column | str, threshold: Column | float, inclusive: bool = False) -> Column:
    """Binary decision; ``inclusive`` switches ``>`` to ``>=``. A missing score or threshold gives NULL."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    above = _col(score) >= limit if inclusive else _col(score) > limit
    return F.when(above, F.lit(POSITIVE)).when(~above, F.lit(NEGATIVE))


@dataclass(frozen=True)
class DecisionRule:
    """Ternary decision rule: ``argmax``, ``diagnosed_margin`` or ``no_evidence_gate``."""

    rule_id: str
    kind: str = "argmax"
    diagnosed_margin: float = 0.0
    no_evidence_min: float = 0.5


# Fixed value: a later class has to be better by more than this to win the argmax.
ARGMAX_EPS = 1e-12


def _argmax(d: Column, c: Column, n: Column) -> Column:
    control_leads = c > d + F.lit(ARGMAX_EPS)
    return (
        F.when(control_leads & (n > c + F.lit(ARGMAX_EPS)), F.lit(NO_EVIDENCE))
        .when(control_leads, F.lit(NEGATIVE))
        .when(n > d + F.lit(ARGMAX_EPS), F.lit(NO_EVIDENCE))
        .otherwise(F.lit(POSITIVE))
    )


def decide_ternary(d: Column | str, c: Column | str, n: Column | str, rule: DecisionRule) -> Column:
    """Ternary decision by a rule; NULL if a probability is missing."""
    d, c, n = _col(d), _col(c), _col(n)
    return F.when(d.isNotNull() & c.isNotNull() & n.isNotNull(), _decide_ternary(d, c, n, rule))


def _decide_ternary(d: Column, c: Column, n: Column, rule: DecisionRule) -> Column:
    if rule.kind == "diagnosed_margin":
        return (
            F.when(d >= F.greatest(c, n) + F.lit(float(rule.diagnosed_margin)), F.lit(POSITIVE))
            .when(c >= n, F.lit(NEGATIVE))
            .otherwise(F.lit(NO_EVIDENCE))
        )
    if rule.kind == "no_evidence_gate":
        gate = (n >= F.lit(float(rule.no_evidence_min))) & (n >= F.greatest(d, c))
        return F.when(gate, F.lit(NO_EVIDENCE)).otherwise(_argmax(d, c, n))
    if rule.kind != "argmax":
        raise ValueError(f"unknown decision rule kind: {rule.kind}")
    return _argmax(d, c, n)


@dataclass(frozen=True)
class LabelPolicy:
    """How a binary label and its evidence marker become a ternary label."""

    policy_id: str
    kind: str  # rel_count_zero, low_density, top10_avg_lt, evidence_quantile
    relevance_threshold: int = 3
    density_threshold: float = 0.01
    top10_avg_threshold: float = 3.0
    quantile: float = 0.0
    applies_to: str = "diagnosed_only"
    quantile_scope: str | None = None

    @property
    def scope(self) -> str:
        if self.quantile_scope:
            return self.quantile_scope
        return "per_binary_label" if self.applies_to == "both_classes" else "diagnosed"


def lacks_evidence(policy: LabelPolicy, cutoff: Column | None = None) -> Column:
    """True where the marker columns of the row show no evidence under the policy."""
    if policy.kind == "rel_count_zero":
        return F.col(f"rel{policy.relevance_threshold}_count") == 0
    if policy.kind == "low_density":
        return F.col("rel3_ratio") <= F.lit(float(policy.density_threshold))
    if policy.kind == "top10_avg_lt":
        return F.col("top10_avg_relevance") < F.lit(float(policy.top10_avg_threshold))
    if policy.kind == "evidence_quantile":
        return F.col("evidence_score") <= F.coalesce(cutoff if cutoff is not None else F.lit(0.0), F.lit(0.0))
    raise ValueError(f"unknown label policy kind: {policy.kind}")


def policy_label(binary_label: Column | str, policy: LabelPolicy, cutoff: Column | None = None) -> Column:
    label = _col(binary_label)
    none = F.when(lacks_evidence(policy, cutoff), F.lit(NO_EVIDENCE)).otherwise(label)
    if policy.applies_to == "both_classes":
        return none
    return F.when(label == NEGATIVE, F.lit(NEGATIVE)).otherwise(none)


def override_decision(base: Column | str, verdict: Column | str) -> Column:
    """One-way override: a positive base turns negative when the verdict is false."""
    return F.when((_col(base) == POSITIVE) & (F.coalesce(_col(verdict), F.lit(True)) == F.lit(False)), F.lit(NEGATIVE)).otherwise(_col(base))
