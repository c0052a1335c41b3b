"""Composite reports: what a user calls first."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratings import SIGNIFICANCE, WASSERSTEIN, statistical_advice, text_advice
from ..operators import assoc, basic, dist, kernel, ml, privacy, text, viz
from ..pair import TablePair

# The advanced measures by family.
CATALOGUE = {
    "statistical": ("wasserstein", "mmd", "transport"),
    "privacy": ("k_anonymity", "l_diversity", "membership"),
    "ml": ("estimators", "utility", "targets"),
    "text": ("lexical", "tfidf", "semantic"),
}


@dataclass(frozen=True)
class Settings:
    """How a report runs; bounds are checked on creation."""

    n_samples: int | None = None
    n_samples_distance: int = 20_000
    kfold: bool = False
    metric: str = "pearsonr"
    text_weight: float = 0.5
    estimators: tuple[str, ...] | None = None
    quasi_identifiers: tuple[str, ...] = ()
    sensitive: tuple[str, ...] = ()
    include_pca: bool = False
    vector_columns: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not 0 <= self.text_weight <= 1:
            raise ValueError("text_weight must be between 0 and 1")
        if self.n_samples is not None and self.n_samples < 1:
            raise ValueError("n_samples must be positive")
        if self.n_samples_distance < 1:
            raise ValueError("n_samples_distance must be positive")
        basic.metric(self.metric)


@dataclass(frozen=True)
class FidelityReport:
    pair: TablePair
    settings: Settings = Settings()

    def __post_init__(self):
        if self.settings.n_samples is not None:
            object.__setattr__(self, "pair", self.pair.sampled(self.settings.n_samples))

    def _check(self, target: str, target_type: str) -> None:
        if target not in self.pair.real.columns:
            raise ValueError(f"no column {target}")
        if target_type not in ("class", "regr"):
            raise ValueError("target_type must be class or regr")

    def _whole(self) -> TablePair:
        """The pair; one with texts is written once, for all its measures."""
        return self.pair.once("stored", self.pair.stored) if self.pair.text else self.pair

    def _compared(self) -> TablePair:
        """The pair with digests in place of texts, for measures that only ask which values are equal."""
        return self.pair.once("digested", lambda: self._whole().digested().stored()) if self.pair.text else self.pair

    def statistics(self) -> dict[str, float]:
        """Scores of the statistics block; both Theil matrices are computed once and serve four of them."""
        pair = self._compared()
        matrices = assoc.association_pair(pair).cache()
        try:
            out = {
                "basic_statistics": basic.basic_statistical_evaluation(pair) if pair.numerical else 0.0,
                "correlation_correlation": assoc.correlation_correlation(pair, matrices).first()[0],
                "distance_rmse": assoc.correlation_distance(pair, "rmse", matrices).first()[1],
                "distance_mae": assoc.correlation_distance(pair, "mae", matrices).first()[1],
                "column_correlation": assoc.column_correlations(pair).agg(F.avg("correlation")).first()[0] or 0.0,
            }
        finally:
            matrices.unpersist()
        if pair.numerical:
            out["js_mean"] = dist.js_distance(pair).agg(F.avg("js_distance")).first()[0]
            out["ks_mean"] = dist.ks(pair).agg(F.avg("statistic")).first()[0]
            if self.settings.include_pca and len(pair.numerical) > 1:
                out["pca_correlation"] = basic.pca_correlation(pair)
        return out

    def evaluate(self, target: str, target_type: str = "class") -> DataFrame:
        """``(section, metric, value)``: statistics, utility, privacy, and the similarity score, the mean of four (or five) of them."""
        self._check(target, target_type)
        pair, own = self._compared(), self.settings
        rows = [("statistics", k, float(v) if v is not None else None) for k, v in self.statistics().items()]
        score = ml.estimator_evaluation(self._whole(), target, target_type, own.kfold, own.metric, estimators=own.estimators)
        rows.append(("ml", "estimator_evaluation", float(score)))
        copied = privacy.copies_count(pair).first()
        twice = privacy.duplicates_count(pair).first()
        rows += [("privacy", "copied", float(copied["copied"])), ("privacy", "real_duplicates", float(twice[0])), ("privacy", "fake_duplicates", float(twice[1]))]
        if pair.numerical:
            near = privacy.row_distance(pair, max_samples=own.n_samples_distance).first()
            rows += [("privacy", "nearest_mean", near[0]), ("privacy", "nearest_std", near[1])]
        known = {k: v for _, k, v in rows}
        parts = ["basic_statistics", "correlation_correlation", "column_correlation", "estimator_evaluation", *(["pca_correlation"] if own.include_pca and "pca_correlation" in known else [])]
        rows.append(("overview", "similarity_score", sum(known[p] or 0.0 for p in parts) / len(parts)))
        return pair.real.sparkSession.createDataFrame(rows, "section string, metric string, value double")

    def statistical(self, max_samples: int = kernel.MAX_SAMPLES) -> tuple[dict[str, DataFrame], list[str]]:
        """Wasserstein, MMD, transport and a combined reading with advice."""
        pair = self.pair
        parts = {
            "basic": basic.statistics_vector(pair),
            "wasserstein_p1": dist.wasserstein_table(pair, p=1),
            "wasserstein_p2": dist.wasserstein_table(pair, p=2),
            "wasserstein_summary": dist.earth_movers_summary(pair),
            "transport": dist.transport_cost(pair),
            "mmd": kernel.mmd_evaluation(pair, max_samples=max_samples),
        }
        w = parts["wasserstein_summary"].select(F.col("quality").alias("wasserstein_quality"))
        m = parts["mmd"].agg(F.avg("quality").alias("mmd_quality"), F.max("joint_mmd").alias("largest_mmd"))
        both = w.join(F.broadcast(m)).withColumn("similarity", (F.col("wasserstein_quality") + F.col("mmd_quality")) / 2)
        parts["combined"] = both.withColumn("significance", SIGNIFICANCE.column(1 - F.col("similarity")))
        return parts, [statistical_advice(parts["combined"].first()["similarity"])]

    def privacy(self, membership: bool = True) -> tuple[dict[str, DataFrame], list[str]]:
        own = self.settings
        qi = list(own.quasi_identifiers) or [r["column"] for r in privacy.quasi_identifiers(self.pair.real).collect()]
        return privacy.privacy_evaluation(self.pair, qi, own.sensitive, membership=membership)

    def advanced(self, membership: bool = True) -> dict[str, DataFrame]:
        """Statistical and privacy parts by name."""
        return {f"statistical_{k}": v for k, v in self.statistical()[0].items()} | {f"privacy_{k}": v for k, v in self.privacy(membership)[0].items()}

    def text(self) -> tuple[DataFrame, dict[str, list[str]]]:
        """A row a text column, and advice by column; a column that fails has its error and no scores, and the others go on."""
        if not self.pair.text:
            raise ValueError("the pair has no text column")
        scores = ("lexical", "tfidf", "jaccard", "overall", "rating", "consistency")
        rows, advice = [], {}
        whole = self.pair.kept.get("stored", self.pair)  # not written for this alone: a column that can't be would cost the others
        for c in self.pair.text:
            try:
                r = text.text_evaluation(whole, c, self.settings.vector_columns.get(c)).first().asDict()
                advice[c] = text_advice(r["overall"], r["jaccard"], r["diversity_ratio"], r["tfidf"], r.get("semantic"), r["spread"])
                rows.append((c, *[r[s] for s in scores], None))
            except Exception as e:  # one column's failure must not cost the others
                rows.append((c, *[None] * len(scores), f"{type(e).__name__}: {e}"[:500]))
        schema = "column string, lexical double, tfidf double, jaccard double, overall double, rating string, consistency string, error string"
        return self.pair.real.sparkSession.createDataFrame(rows, schema), advice

    def text_summary(self) -> DataFrame:
        """One row ``(type, mean, median, min, max, columns, error)`` over the text columns that could be measured."""
        table, _ = self.text()
        out = table.agg(F.avg("overall").alias("mean"), F.percentile("overall", F.lit(0.5)).alias("median"), F.min("overall").alias("min"), F.max("overall").alias("max"), F.count("overall").alias("columns"), F.min("error").alias("error"))
        return out.select(F.lit("text").alias("type"), "mean", "median", "min", "max", "columns", "error")

    def wasserstein(self, include_2d: bool = False, p: int = 1) -> DataFrame:
        """``(column, wasserstein_distance, method, quality, rating)`` of each column and, with ``include_2d``, of each pair of columns."""
        out = dist.wasserstein_table(self.pair, p=p)
        if include_2d and len(self.pair.numerical) > 1:
            out = out.unionByName(dist.wasserstein_table(self.pair, method="2d"))
        d = F.col("wasserstein_distance")
        return out.withColumns({"quality": 1 / (1 + d), "rating": WASSERSTEIN.column(d)})

    # short forms of measures of the pair
    def copies(self) -> DataFrame:
        return privacy.copies(self.pair)

    def duplicates(self) -> tuple[DataFrame, DataFrame]:
        return privacy.duplicates(self.pair.real), privacy.duplicates(self.pair.fake)

    def row_distance(self, max_samples: int | None = None) -> DataFrame:
        return privacy.row_distance(self.pair, max_samples=max_samples or self.settings.n_samples_distance)

    def correlation_distance(self, how: str = "euclidean") -> DataFrame:
        return assoc.correlation_distance(self.pair, how)

    def column_correlations(self) -> DataFrame:
        return assoc.column_correlations(self.pair)

    def basic_statistical_evaluation(self) -> float:
        return basic.basic_statistical_evaluation(self.pair)

    def pca_correlation(self, lingress: bool = False) -> float:
        return basic.pca_correlation(self.pair, lingress=lingress, how=self.settings.metric)

    def estimator_evaluation(self, target: str, target_type: str = "class") -> float:
        self._check(target, target_type)
        return ml.estimator_evaluation(self.pair, target, target_type, self.settings.kfold, self.settings.metric, estimators=self.settings.estimators)

    def size_notes(self) -> list[str]:
        """What a user should know of the pair's size before measures that compare rows with rows, which take samples."""
        n = max(self.pair.real.count(), self.pair.fake.count())
        out = [f"{n} rows: {name} takes at most {most} of a side" for name, most in (("the RBF kernel", kernel.MAX_SAMPLES), ("the nearest-row distance", self.settings.n_samples_distance)) if n > most]
        for line in out:
            logging.getLogger(__name__).warning(line)
        return out

    def with_text(self, target: str, target_type: str = "class") -> DataFrame:
        """One row ``(tabular, text, combined)``: w * text + (1 - w) * tabular."""
        tabular = self.evaluate(target, target_type).where("metric = 'similarity_score'").first()["value"]
        words = self.text_summary().first()["mean"]
        w = self.settings.text_weight
        return self.pair.real.sparkSession.createDataFrame([(tabular, words, w * words + (1 - w) * tabular)], "tabular double, text double, combined double")

    def plots(self, folder: str | None = None) -> dict[str, DataFrame]:
        return viz.visual_evaluation(self.pair, folder)


def available_metrics(spark) -> DataFrame:
    """``(family, measure)`` of the advanced measures."""
    return spark.createDataFrame([(f, m) for f, ms in CATALOGUE.items() for m in ms], "family string, measure string")


def sections(results: dict[str, Sequence[tuple[str, float]]], spark) -> DataFrame:
    """``(section, metric, value)`` for display in tabs."""
    return spark.createDataFrame([(s, m, float(v)) for s, rows in results.items() for m, v in rows], "section string, metric string, value double")
