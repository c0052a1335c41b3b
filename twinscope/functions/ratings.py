"""Rating scales and advice, as columns and as plain functions of a number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scale:
    """Levels in order, each with its bound; ``rising`` scales ask for at least the bound, falling ones for less than it."""

    bounds: tuple[float, ...]
    rising: bool
    labels: tuple[str, ...] = ("Excellent", "Good", "Fair", "Poor")
    last: str = "Very Poor"
    strict: bool = False  # a rising scale whose bound itself isn't enough

    def column(self, x: Column) -> Column:
        out = F.when(x.isNull() | F.isnan(x.cast("double")), "Unknown")
        for bound, label in zip(self.bounds, self.labels, strict=True):
            out = out.when((x > bound if self.strict else x >= bound) if self.rising else x < bound, label)
        return out.otherwise(self.last)

    def of(self, x: float | None) -> str:
        if x is None or x != x:
            return "Unknown"
        for bound, label in zip(self.bounds, self.labels, strict=True):
            if (x > bound if self.strict else x >= bound) if self.rising else x < bound:
                return label
        return self.last

    def sql(self, x: str) -> str:
        test = (">" if self.strict else ">=") if self.rising else "<"
        return "CASE " + " ".join(f"WHEN {x} {test} {b} THEN '{v}'" for b, v in zip(self.bounds, self.labels, strict=True)) + f" ELSE '{self.last}' END"


# Bounds of the rating scales.
WASSERSTEIN = Scale((0.1, 0.25, 0.5, 1.0), False)
MMD = Scale((0.01, 0.05, 0.1, 0.2), False)
ML_CLASSIFICATION = Scale((0.9, 0.8, 0.7, 0.6), True)
ML_REGRESSION = Scale((0.9, 0.7, 0.5, 0.3), True)
ML_OVERALL = Scale((0.8, 0.7, 0.6, 0.5), True)
LEXICAL = TFIDF = Scale((0.9, 0.8, 0.6, 0.4), True)
SEMANTIC = Scale((0.95, 0.85, 0.7, 0.5), True)
TEXT_OVERALL = Scale((0.85, 0.75, 0.6, 0.4), True)
K_ANONYMITY = Scale((5, 3, 2), True, ("Good", "Moderate", "Weak"), "Poor")
ATTACK_RISK = Scale((0.75, 0.6), True, ("High", "Medium"), "Low", strict=True)
SIGNIFICANCE = Scale((0.5, 0.2), True, ("High", "Medium"), "Low", strict=True)
DISCRIMINATION = Scale((0.1, 0.05), True, ("High", "Medium"), "Low", strict=True)
CONSISTENCY = Scale((0.1, 0.2), False, ("High", "Medium"), "Low")


def attack_advice(accuracy: float) -> str:
    level = ATTACK_RISK.of(accuracy)
    return {
        "High": "An attacker tells members apart: add noise or regenerate with privacy guarantees.",
        "Medium": "An attacker has some advantage: consider stronger privacy settings.",
        "Low": "An attacker does hardly better than chance.",
    }[level]


def statistical_advice(similarity: float) -> str:
    if similarity < 0.3:
        return "Low similarity: review how the table was generated."
    if similarity < 0.7:
        return "Moderate similarity: look at the worst columns."
    return "Good similarity."


def text_advice(overall: float, jaccard: float | None = None, diversity: float | None = None, tfidf: float | None = None, semantic: float | None = None, spread: float | None = None) -> list[str]:
    out = ["Low text similarity: review the text generator." if overall < 0.4 else "Moderate text similarity." if overall < 0.7 else "Good text similarity."]
    if jaccard is not None and jaccard < 0.3:
        out.append("The vocabularies hardly overlap.")
    if diversity is not None and not 0.5 <= diversity <= 2:
        out.append("The vocabularies differ in size.")
    if tfidf is not None and tfidf < 0.5:
        out.append("Terms are weighted differently.")
    if semantic is not None and semantic < 0.7:
        out.append("Meanings drift apart.")
    if spread is not None and spread > 0.2:
        out.append("The measures disagree with each other.")
    return out


def privacy_advice(copied_fraction: float, k: int, accuracy: float, level: str) -> list[str]:
    out = []
    if copied_fraction > 0.01:
        out.append("Rows of the original occur in the copy: remove them.")
    if k < 5:
        out.append("Small classes of quasi-identifiers: generalise or suppress them.")
    if accuracy > 0.6:
        out.append(attack_advice(accuracy))
    if level == "High":
        out.append("Don't publish this table as it is.")
    return out or ["No privacy problem found."]
