"""Privacy measures: copies, duplicates, nearest rows, k-anonymity, l-diversity, membership attacks, risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratings import ATTACK_RISK, K_ANONYMITY, privacy_advice
from ..functions.scalar import clamp
from ..pair import SEED, TablePair, is_numeric, row_key
from ..work import materialize
from .nearest import nearest

NEUTRAL_ACCURACY = 0.5


def copies(pair: TablePair) -> DataFrame:
    """The rows of the fake side, as often as they occur there, that occur on the real side; nulls are equal."""
    return _repeated(_counted(pair).where("__r > 0 and __f > 0"), "__f").select(*pair.fake.columns)


def _counted(pair: TablePair) -> DataFrame:
    """The distinct rows with how often each side has them: counted before they shuffle, nulls equal."""
    return pair.tagged().groupBy(*pair.real.columns).agg(F.sum("side").alias("__r"), F.sum(1 - F.col("side")).alias("__f"))


def novel_rows(pair: TablePair) -> DataFrame:
    """The rows of the fake side that don't occur on the real side."""
    return _repeated(_counted(pair).where("__r = 0 and __f > 0"), "__f").select(*pair.fake.columns)


def copies_count(pair: TablePair) -> DataFrame:
    """One row ``(copied, fraction)``: by one aggregate over both sides, so that a row that fills a third of a table isn't gathered."""
    n = F.coalesce(F.sum(F.when(F.col("__r") > 0, F.col("__f"))), F.lit(0)).cast("long")
    return _counted(pair).agg(n.alias("copied"), F.coalesce(F.try_divide(n.cast("double"), F.sum("__f").cast("double")), F.lit(0.0)).alias("fraction"))


def duplicates(df: DataFrame) -> DataFrame:
    """All members of groups of equal rows, with ``group_size``."""
    # counted before they shuffle, and written out as often as they occur: a row that fills a third of the table is one row until then
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("group_size")).where("group_size > 1")
    return _repeated(groups, "group_size").select(*df.columns, "group_size")


def _repeated(groups: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times, a great many in several tasks."""
    step = 1 << 16
    whole = F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / step))
    parts = groups.withColumn("__part", F.explode(whole)).repartition(*groups.columns, "__part")
    size = F.least(F.lit(step).cast("long"), F.col(times) - F.col("__part") * step)
    return parts.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), size))).drop("__part", "__copy")


def duplicates_count(pair: TablePair) -> DataFrame:
    """One row ``(real_duplicates, fake_duplicates)``: members of groups of equal rows on each side."""
    counted = _counted(pair)
    members = lambda c: F.coalesce(F.sum(F.when(F.col(c) > 1, F.col(c))), F.lit(0)).cast("long")
    return counted.agg(members("__r").alias("real_duplicates"), members("__f").alias("fake_duplicates"))


def row_distance(pair: TablePair, columns: Sequence[str] | None = None, max_samples: int | None = None, direction: str = "real") -> DataFrame:
    """One row ``(mean_distance, std_distance, n)``: from each real row to the nearest fake one, over all rows, or ``max_samples`` of a side by hash order.

    ``direction`` ``fake`` goes the other way; ``n`` is how many rows looked for their nearest one.
    """
    own = list(columns or pair.numerical)

    def take(df: DataFrame) -> DataFrame:
        rows = df.select(*[F.col(c).cast("double").alias(c) for c in own]).na.drop()
        return rows if max_samples is None else rows.orderBy(row_key(own, pair.seed), *own).limit(max_samples)

    a, b = (pair.real, pair.fake) if direction == "real" else (pair.fake, pair.real)
    near = nearest(take(a), take(b), own)
    n, d = F.col("n"), F.col("d")
    # deviations from the mean in a second pass: sums of squares would lose the digits of equal distances
    mean = near.agg((F.sum(n * d) / F.sum("n")).alias("mean"))
    out = near.join(F.broadcast(mean)).agg(F.max("mean").alias("mean"), F.sqrt(F.sum(n * (d - F.col("mean")) * (d - F.col("mean"))) / F.sum("n")).alias("std"), F.sum("n").alias("n"))
    return out.select(F.coalesce("mean", F.lit(0.0)).alias("mean_distance"), F.coalesce("std", F.lit(0.0)).alias("std_distance"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def quasi_identifiers(df: DataFrame, max_unique_ratio: float = 0.9, min_unique_count: int = 2, min_unique_ratio: float = 0.01) -> DataFrame:
    """``(column, distinct, ratio)`` of the columns that may identify rows in combination; one aggregate for all columns."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.countDistinct(c).alias(c) for c in df.columns])
    each = counts.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct")) for c in df.columns])).alias("e")).select("__n", "e.*")
    ratio = F.coalesce(F.try_divide(F.col("distinct").cast("double"), F.col("__n").cast("double")), F.lit(0.0))
    return each.select("column", "distinct", ratio.alias("ratio")).where((F.col("distinct") >= min_unique_count) & (F.col("ratio") > min_unique_ratio) & (F.col("ratio") <= max_unique_ratio))


def describe(df: DataFrame, value: str) -> DataFrame:
    """One row ``(n, mean, std, min, p25, p50, p75, max)`` of a column."""
    p = lambda q: F.percentile(value, F.lit(q))
    return df.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).cast("double").alias("min"),
        p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"), F.max(value).cast("double").alias("max"),
    )


def equivalence_classes(df: DataFrame, qi: Sequence[str], sensitive: Sequence[str] = ()) -> DataFrame:
    """``(qi..., size, l_<sensitive>...)``: rows with a null quasi-identifier are left out."""
    return df.na.drop(subset=list(qi)).groupBy(*qi).agg(F.count("*").alias("size"), *[F.countDistinct(s).alias(f"l_{s}") for s in sensitive])


def k_anonymity(df: DataFrame, qi: Sequence[str], k: int = 5) -> DataFrame:
    """One row ``(k, classes, mean_size, violations, level)``; ``violations`` counts classes smaller than the parameter ``k``."""
    if not qi:
        return df.sparkSession.createDataFrame([(0, 0, 0.0, 0, "Error")], "k long, classes long, mean_size double, violations long, level string")
    sizes = equivalence_classes(df, qi)
    out = sizes.agg(
        F.coalesce(F.min("size"), F.lit(0)).alias("k"), F.count("*").alias("classes"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean_size"),
        F.coalesce(F.sum((F.col("size") < k).cast("long")), F.lit(0)).alias("violations"),
    )
    return out.withColumn("level", K_ANONYMITY.column(F.col("k")))


def class_size_distribution(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    return describe(equivalence_classes(df, qi), "size")


def l_diversity(df: DataFrame, qi: Sequence[str], sensitive: str) -> DataFrame:
    """One row ``(l, mean_l, below_2)`` over the classes."""
    classes = equivalence_classes(df, qi, [sensitive])
    x = F.col(f"l_{sensitive}")
    return classes.agg(F.min(x).alias("l"), F.avg(x).alias("mean_l"), F.coalesce(F.sum((x < 2).cast("long")), F.lit(0)).alias("below_2"))


def attack_columns(df: DataFrame, most: int = 20) -> list[str]:
    """Numbers, and columns of at most ``most`` distinct values."""
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    rest = [c for c in df.columns if c not in numbers]
    few = df.agg(*[F.countDistinct(c).alias(c) for c in rest]).first() if rest else {}
    return [c for c in df.columns if c in numbers or few[c] <= most]


def membership_attack(pair: TablePair, columns: Sequence[str] | None = None, test_size: float = 0.3, max_samples: int = 5000, seed: int = SEED) -> DataFrame:
    """``(model, accuracy, precision, recall, auc, risk)``: can a classifier tell real rows from fake ones?

    Both sides give equally many rows, ``max_samples`` at most, by hash order;
    text is coded on their union; each side is split by a hash of the row.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from .ml import features

    own = list(columns or attack_columns(pair.real))
    n = min(max_samples, pair.real.count(), pair.fake.count())
    take = lambda df: df.select(*own).orderBy(row_key(own, seed), *own).limit(n)
    rows = take(pair.real).withColumn("label", F.lit(1.0)).unionByName(take(pair.fake).withColumn("label", F.lit(0.0)))
    names, stages = features(rows, own)
    part = F.pmod(F.xxhash64(*own, "label"), F.lit(1000)) / 1000.0
    rows = materialize(rows.withColumn("__test", part < test_size), "attack")
    prep = Pipeline(stages=[*stages, VectorAssembler(inputCols=names, outputCol="__raw", handleInvalid="keep"), StandardScaler(inputCol="__raw", outputCol="features", withMean=True)]).fit(rows)
    train, test = (prep.transform(rows.where(c)).select("label", "features") for c in ("not __test", "__test"))
    models = {"logistic_regression": LogisticRegression(maxIter=1000), "random_forest": RandomForestClassifier(numTrees=100, seed=seed)}
    out: DataFrame | None = None
    for name, m in models.items():
        scored = m.fit(train).transform(test)
        auc = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction").evaluate(scored)
        p, y = F.col("prediction"), F.col("label")
        hit = lambda a, b: F.sum(((p == a) & (y == b)).cast("double"))  # noqa: B023, E731
        row = scored.agg(
            F.lit(name).alias("model"), F.coalesce(F.avg((p == y).cast("double")), F.lit(NEUTRAL_ACCURACY)).alias("accuracy"),
            F.coalesce(F.try_divide(hit(1, 1), hit(1, 1) + hit(1, 0)), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(hit(1, 1), hit(1, 1) + hit(0, 1)), F.lit(0.0)).alias("recall"), F.lit(auc).alias("auc"),
        )
        out = row if out is None else out.unionByName(row)
    return out.withColumn("risk", ATTACK_RISK.column(F.col("accuracy")))


def risk_columns(k: Column, accuracy: Column, copied: Column) -> dict[str, Column]:
    """The two readings of overall risk, as columns of k, attack accuracy and copied fraction."""
    inference = F.when(accuracy > 0.6, 2 * (accuracy - 0.5)).otherwise(F.lit(0.0))
    k_part = F.when(k < 2, F.lit(0.2)).when(k < 5, k / 5.0).otherwise(F.lit(1.0))
    level = F.when((k < 2) | (accuracy > 0.75) | (copied > 0.1), "High").when((k < 5) | (accuracy > 0.6) | (copied > 0.01), "Moderate").otherwise("Low")
    return {
        "risk_level": level,
        "k_score": F.least(F.lit(1.0), k / 10.0),
        "membership_score": F.greatest(F.lit(0.0), 1 - 2 * (accuracy - 0.5)),
        "privacy_score": clamp(F.when(k < 5, k / 5.0).otherwise(F.lit(1.0)) * F.greatest(F.lit(0.0), 1 - 2 * (accuracy - 0.5)), 0.0, 1.0),
        "overall_score": clamp(k_part * (1 - inference) * (1 - 2 * copied), 0.0, 1.0),
    }


def privacy_risk(pair: TablePair, qi: Sequence[str], accuracy: float = NEUTRAL_ACCURACY) -> DataFrame:
    """One row with k, copied fraction and the risk columns, for a given accuracy of an attack."""
    k = k_anonymity(pair.fake, qi).select("k")
    both = k.join(F.broadcast(copies_count(pair).select("fraction")))
    made = risk_columns(F.col("k").cast("double"), F.lit(float(accuracy)), F.col("fraction"))
    return both.withColumns(made)


def privacy_evaluation(pair: TablePair, qi: Sequence[str], sensitive: Sequence[str] = (), basic: bool = True, k_anon: bool = True, membership: bool = True) -> tuple[dict[str, DataFrame], list[str]]:
    """All parts as tables by name, and advice. A part that fails is a table with its error instead."""
    parts: dict[str, DataFrame] = {}
    spark = pair.real.sparkSession

    def attempt(name: str, make) -> None:
        try:
            df = make()
            parts[name] = spark.createDataFrame(df.collect(), df.schema)  # a few rows; what fails, fails here
        except Exception as e:  # one part's failure must not cost the others
            parts[name] = spark.createDataFrame([(type(e).__name__, str(e)[:500], name)], "error_type string, error string, function_name string")

    if basic:
        attempt("copies", lambda: copies_count(pair))
        attempt("duplicates", lambda: duplicates_count(pair))
        attempt("row_distance", lambda: row_distance(pair))
    if k_anon:
        attempt("k_anonymity", lambda: k_anonymity(pair.fake, qi))
        for s in sensitive:
            attempt(f"l_diversity_{s}", lambda s=s: l_diversity(pair.fake, qi, s))
    accuracy = NEUTRAL_ACCURACY
    if membership:
        attempt("membership", lambda: membership_attack(pair))
        if "accuracy" in parts["membership"].columns:
            accuracy = parts["membership"].agg(F.max("accuracy")).first()[0] or NEUTRAL_ACCURACY
    attempt("risk", lambda: privacy_risk(pair, qi, accuracy))
    advice: list[str] = []
    if "risk_level" in parts["risk"].columns:
        r = parts["risk"].first()
        advice = privacy_advice(r["fraction"], r["k"], accuracy, r["risk_level"])
    return parts, advice
