"""Machine-learning utility: train on one side, test on the other."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratings import ML_CLASSIFICATION, ML_OVERALL, ML_REGRESSION
from ..pair import SEED, TablePair, is_numeric
from ..work import materialize
from . import encode
from .basic import metric

FOLDS = 5
MAX_DEPTH = 30
ROWS_PER_PARTITION = 50_000


def features(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list]:
    """Feature column names and the stages that make them: text of few values is indexed by its sorted values, numbers pass through.

    The values of a column reach the driver, so this is for samples. A code is a number like any other, however many values a column has: a tree splits it by size.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in columns if not is_numeric(kinds[c])]
    stages = [StringIndexer(inputCol=c, outputCol=f"__ix_{c}", stringOrderType="alphabetAsc", handleInvalid="keep") for c in text]
    if text:  # a sum has no list of values, which would make the column a set of categories
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(f"`__ix_{c}` + 0.0D AS `__code_{c}`" for c in text) + " FROM __THIS__"))
    return [f"__code_{c}" if c in text else c for c in columns], stages


def _ready(pair: TablePair, target: str, kind: str) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with ``features`` and ``label``, encoded on their union, and the number of classes."""
    own = [c for c in pair.real.columns if c != target]
    both = pair.tagged()
    as_text = [c for c in both.columns if c != "side" and not is_numeric(both.schema[c].dataType)]
    both = both.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("[NAN]")) for c in as_text} | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in own if c not in as_text}).where(F.col(target).isNotNull())
    if kind == "class":
        both = both.withColumn(target, F.col(target).cast("string"))
        stages = [StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc")]
    else:
        both = both.withColumn("label", F.col(target).cast("double"))
        stages = []
    both = both.withColumn("__fold", F.pmod(F.xxhash64(*own, target), F.lit(1 << 30)) / float(1 << 30))
    # a code is a number like any other, however many values a column has; whole texts stay off the driver and out of the models
    if text := [c for c in own if c in as_text]:
        both = materialize(encode.coded(both, text), "ml-coded")
    model = Pipeline(stages=[*stages, VectorAssembler(inputCols=own, outputCol="features")]).fit(both)
    out = model.transform(both)
    classes = len(model.stages[-2].labels) if kind == "class" else 0
    part = lambda s: out.where(F.col("side") == s).select("features", "label", F.col("__fold").alias("fold"))
    # iterative fits run a job a step: small tables go in few partitions
    few = max(1, both.count() // ROWS_PER_PARTITION)
    return part(1).coalesce(few), part(0).coalesce(few), classes


def classifiers(n_rows: int, n_features: int, n_classes: int, seed: int = SEED) -> dict:
    return {
        "LogisticRegression": LogisticRegression(maxIter=500, regParam=1.0 / max(1, n_rows), standardization=False),
        "RandomForestClassifier": RandomForestClassifier(numTrees=10, maxDepth=MAX_DEPTH, maxBins=256, seed=seed),
        "DecisionTreeClassifier": DecisionTreeClassifier(maxDepth=MAX_DEPTH, maxBins=256, seed=seed),
        "MLPClassifier": MultilayerPerceptronClassifier(layers=[n_features, 50, 50, max(2, n_classes)], maxIter=100, seed=seed),
    }


def regressors(label_std: float, n_rows: int, seed: int = SEED) -> dict:
    """Penalties so set that they mean what an unscaled library means by alpha 1: Spark divides the L2 part by the label's deviation."""
    s = label_std or 1.0
    linear = lambda reg, mix: LinearRegression(regParam=reg, elasticNetParam=mix, standardization=False, maxIter=200)
    return {
        "RandomForestRegressor": RandomForestRegressor(numTrees=20, maxDepth=5, maxBins=256, seed=seed),
        "Lasso": linear(1.0, 1.0),
        "Ridge": linear(s / max(1, n_rows), 0.0),
        "ElasticNet": linear(0.5 + 0.5 * s, 0.5 / (0.5 + 0.5 * s)),
    }


def _compare(scored: DataFrame, kind: str) -> list[Column]:
    y, a, b = F.col("label"), F.col("by_real"), F.col("by_fake")
    if kind == "class":
        same = F.sum((a == b).cast("double"))
        n = F.count("*")
        return [F.avg((a == y).cast("double")).alias("real"), F.avg((b == y).cast("double")).alias("fake"), F.try_divide(same, 2 * n - same).alias("jaccard")]
    root = lambda x: F.sqrt(F.avg((x - y) * (x - y)))
    return [root(a).alias("real"), root(b).alias("fake"), F.lit(None).cast("double").alias("jaccard")]


def estimator_scores(pair: TablePair, target: str, target_type: str = "class", kfold: bool = False, estimators: Sequence[str] | None = None, seed: int = SEED) -> DataFrame:
    """``(estimator, tested_on, trained_on_real, trained_on_fake, jaccard)``: micro-F1 (classes) or RMSE, mean over the folds.

    Folds are cut by a hash of the row; only the first is used unless ``kfold``.
    """
    if target_type not in ("class", "regr"):
        raise ValueError("target_type must be class or regr")
    real, fake, classes = _ready(pair, target, target_type)
    real, fake = materialize(real, "ml-real"), materialize(fake, "ml-fake")
    first = real.select("features").first()
    n_features = first["features"].size if first else 0
    rows = []
    for k in range(FOLDS if kfold else 1):
        inside = (F.col("fold") >= k / FOLDS) & (F.col("fold") < (k + 1) / FOLDS)
        train_r, train_f = real.where(~inside), fake.where(~inside)
        tests = {"real": real.where(inside), "fake": fake.where(inside)}
        shape = train_r.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
        make = lambda: classifiers(shape["n"], n_features, classes, seed) if target_type == "class" else regressors(shape["s"] or 1.0, shape["n"], seed)  # noqa: B023, E731
        for name, m in make().items():
            if estimators and name not in estimators:
                continue
            by_real, by_fake = m.fit(train_r), make()[name].fit(train_f)
            for on, test in tests.items():
                scored = by_real.transform(test).select("features", "label", F.col("prediction").alias("by_real"))
                scored = by_fake.transform(scored).withColumnRenamed("prediction", "by_fake")
                r = scored.agg(*_compare(scored, target_type)).first()
                rows.append((name, on, r["real"], r["fake"], r["jaccard"]))
    out = pair.real.sparkSession.createDataFrame(rows, "estimator string, tested_on string, trained_on_real double, trained_on_fake double, jaccard double")
    return out.groupBy("estimator", "tested_on").agg(*[F.avg(c).alias(c) for c in ("trained_on_real", "trained_on_fake", "jaccard")])


def estimator_evaluation(pair: TablePair, target: str, target_type: str = "class", kfold: bool = False, how: str | Callable = "pearsonr", **more) -> float:
    """1 - MAPE between scores of models trained on either side (classes), or their comparison (regression)."""
    rows = estimator_scores(pair, target, target_type, kfold, **more).collect()
    a, b = [r["trained_on_real"] for r in rows], [r["trained_on_fake"] for r in rows]
    if target_type == "class":
        parts = [abs((x - y) / x) for x, y in zip(a, b, strict=True) if x]
        return 1 - sum(parts) / len(parts) if parts else 0.0
    return metric(how)(a, b)


def detect_task(df: DataFrame, target: str) -> str:
    """Classification for text and for numbers of fewer than 20 distinct values."""
    if not is_numeric(df.schema[target].dataType):
        return "classification"
    return "classification" if df.agg(F.countDistinct(target)).first()[0] < 20 else "regression"


def _utility_models(kind: str, seed: int) -> dict:
    if kind == "classification":
        return {"random_forest": RandomForestClassifier(numTrees=100, maxBins=256, seed=seed), "logistic_regression": LogisticRegression(maxIter=1000)}
    return {"random_forest": RandomForestRegressor(numTrees=100, maxBins=256, seed=seed), "linear_regression": LinearRegression()}


def _quality(scored: DataFrame, kind: str) -> dict[str, float]:
    if kind == "classification":
        e = MulticlassClassificationEvaluator()
        return {m: e.evaluate(scored, {e.metricName: n}) for m, n in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1"))}
    e = RegressionEvaluator()
    return {m: e.evaluate(scored, {e.metricName: m}) for m in ("mse", "mae", "r2")}


def ml_utility(pair: TablePair, target: str, task: str = "auto", test_size: float = 0.2, models: Sequence[str] | None = None, seed: int = SEED) -> DataFrame:
    """``(model, task, metric, real_score, synthetic_score, ratio)``: both tested on rows of the real side that no model saw."""
    task = detect_task(pair.real, target) if task == "auto" else task
    real, fake, _ = _ready(pair, target, "class" if task == "classification" else "regr")
    real, fake = materialize(real, "ml-real"), materialize(fake, "ml-fake")
    train, test = real.where(F.col("fold") >= test_size), real.where(F.col("fold") < test_size)
    rows = []
    for name, m in _utility_models(task, seed).items():
        if models and name not in models:
            continue
        own, other = _quality(m.fit(train).transform(test), task), _quality(m.fit(fake).transform(test), task)
        rows += [(name, task, k, own[k], other[k], other[k] / own[k] if own[k] else None) for k in own]
    return pair.real.sparkSession.createDataFrame(rows, "model string, task string, metric string, real_score double, synthetic_score double, ratio double")


def utility_summary(table: DataFrame) -> DataFrame:
    """One row ``(utility, best_model, rating)`` over accuracy or R2."""
    main = table.where("metric in ('accuracy', 'r2')")
    return main.agg(F.try_divide(F.avg("synthetic_score"), F.avg("real_score")).alias("utility"), F.max_by("model", "synthetic_score").alias("best_model")).withColumn("rating", ML_OVERALL.column(F.col("utility")))


def class_report(pair: TablePair, target: str, seed: int = SEED) -> DataFrame:
    """``(label, precision, recall, f1, support)`` of a forest trained on the fake and tested on the real side."""
    real, fake, _ = _ready(pair, target, "class")
    scored = RandomForestClassifier(numTrees=100, maxBins=256, seed=seed).fit(fake).transform(real)
    cells = scored.groupBy("label", "prediction").agg(F.count("*").cast("double").alias("n"))
    each = cells.select("n", F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("own"), F.lit(0.0).alias("said")), F.struct(F.col("prediction").alias("c"), F.lit(0.0).alias("own"), F.col("n").alias("said")))).alias("e"), (F.col("label") == F.col("prediction")).alias("hit")).select("n", "hit", "e.*")
    sums = each.groupBy(F.col("c").alias("label")).agg(F.sum("own").alias("own"), F.sum("said").alias("said"), F.sum(F.when(F.col("hit") & (F.col("own") > 0), F.col("n")).otherwise(0.0)).alias("hits"))
    p, r = F.coalesce(F.try_divide(F.col("hits"), F.col("said")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("hits"), F.col("own")), F.lit(0.0))
    return sums.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), F.col("own").cast("long").alias("support"))


def train_test_on_synthetic(pair: TablePair, target: str, task: str = "auto", test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """``(metric, real_score, synthetic_score, ratio, difference)``: a forest trained on either side, both tested on rows of the real side that neither saw.

    Accuracy for classes; mean squared and absolute error and R2 for numbers.
    ``ratio`` is the synthetic score over the real one, ``difference`` the real score
    less the synthetic one.
    """
    task = detect_task(pair.real, target) if task == "auto" else task
    table = ml_utility(pair, target, task, test_size, ["random_forest"], seed)
    kept = ("accuracy",) if task == "classification" else ("mse", "mae", "r2")
    return table.where(F.col("metric").isin(*kept)).select("metric", "real_score", "synthetic_score", "ratio", (F.col("real_score") - F.col("synthetic_score")).alias("difference"))


def target_columns(df: DataFrame, max_targets: int = 5) -> DataFrame:
    """``(column, task, distinct, unique_ratio)`` of the columns that suit as targets, the least varied first.

    A column with more than half nulls is left out. Text is a class target with
    up to min(50, 10 %) values, a number with 2 to min(20, 5 %); a number with at
    least 10 values and 5 % is a regression target.
    """
    cols = [f.name for f in df.schema.fields]
    numeric = {f.name for f in df.schema.fields if is_numeric(f.dataType)}
    got = df.agg(F.count(F.lit(1)).alias("__n"), *[F.countDistinct(c).alias(f"d_{c}") for c in cols], *[F.count(c).alias(f"c_{c}") for c in cols])
    each = got.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in numeric).alias("num"), F.col(f"d_{c}").alias("distinct"), F.col(f"c_{c}").alias("present")) for c in cols])).alias("e")).select("__n", "e.*")
    n, d = F.col("__n").cast("double"), F.col("distinct")
    task = F.when(~F.col("num") & (d >= 2) & (d <= F.least(F.lit(50.0), 0.1 * n)), "classification").when(F.col("num") & (d >= 2) & (d <= F.least(F.lit(20.0), 0.05 * n)), "classification").when(F.col("num") & (d >= 10) & (d >= 0.05 * n), "regression")
    out = each.where(F.col("present") >= 0.5 * n).select("column", task.alias("task"), "distinct", F.try_divide(d.cast("double"), n).alias("unique_ratio")).where("task is not null")
    return out.orderBy("unique_ratio", "column").limit(max_targets)


def ml_evaluation(pair: TablePair, targets: Sequence[str] | None = None, max_targets: int = 5, estimators: Sequence[str] | None = None) -> DataFrame:
    """``(target, task, score, rating, error)`` of each target; no target gives no row."""
    if targets:
        tasks = [(t, detect_task(pair.real, t)) for t in targets]
    else:
        tasks = [(r["column"], r["task"]) for r in target_columns(pair.real, max_targets).collect()]
    rows = []
    for target, task in tasks:
        try:
            score = estimator_evaluation(pair, target, "class" if task == "classification" else "regr", estimators=estimators)
            rows.append((target, task, float(score), (ML_CLASSIFICATION if task == "classification" else ML_REGRESSION).of(score), None))
        except Exception as e:  # one target's failure must not cost the others
            rows.append((target, task, None, "Unknown", f"{type(e).__name__}: {e}"[:500]))
    return pair.real.sparkSession.createDataFrame(rows, "target string, task string, score double, rating string, error string")
