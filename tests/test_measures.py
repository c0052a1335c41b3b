"""Known values, invariants and edge cases of the measures."""

import math
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinscope.functions import ratings, scalar
from twinscope.operators import assoc, basic, dist, encode, kernel, ml, nearest, privacy, text, viz
from twinscope.pair import MISSING, TablePair
from twinscope.plans.report import FidelityReport, Settings
from twinscope.sources.files import align_loaded, load_csv_pair, write_report


@pytest.fixture(scope="module")
def small(spark):
    real = [(i + 1, "abcde"[i], (i + 1) / 10, i % 2 == 0) for i in range(5)]
    fake = [(i + 1, "abcdf"[i], (i + 1) / 10 + 0.05, x) for i, x in enumerate((True, True, False, False, True))]
    make = lambda rows: spark.createDataFrame(rows, "A int, B string, C double, D boolean")
    return TablePair.of(make(real), make(fake))


def numbers(spark, real, fake, kind="double"):
    make = lambda v: spark.createDataFrame([(x,) for x in v], f"x {kind}")
    return TablePair.of(make(real), make(fake))


def texts(spark, real, fake):
    make = lambda v: spark.createDataFrame([(x,) for x in v], "t string")
    return TablePair.of(make(real), make(fake), text_cols=["t"])


def one(df):
    return df.first()[0]


@contextmanager
def session(spark, ranges):
    """As many ranges as that, none of them joined."""
    own = {"spark.sql.shuffle.partitions": str(ranges), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_scalar_goldens(spark):
    pairs = lambda *p: spark.createDataFrame([(float(a), float(b)) for a, b in p], "a double, b double")
    assert one(pairs((1, 2)).agg(scalar.mean_absolute_percentage_error("a", "b"))) == 1.0
    assert one(pairs((1, 2), (1, 2)).agg(scalar.mean_absolute_error("a", "b"))) == 1.0
    assert one(pairs((0, 1), (0, 1)).agg(scalar.euclidean_distance("a", "b"))) == pytest.approx(1.41421356)
    assert one(pairs((0, 2), (0, 2)).agg(scalar.rmse("a", "b"))) == 2.0
    assert one(pairs((0, 2)).agg(scalar.mean_absolute_percentage_error("a", "b"))) == math.inf
    assert one(pairs((1, 5), (1, 7)).agg(scalar.correlation("a", "b"))) is None


def test_roles(spark, small):
    assert small.numerical == ("A", "C") and small.categorical == ("B", "D")
    assert TablePair.of(small.real, small.fake, unique_thresh=5).numerical == ()
    assert TablePair.of(small.real, small.fake.select("D", "C", "B", "A"), cat_cols=["A"]).numerical == ("B", "C", "D")
    with pytest.raises(ValueError):
        TablePair.of(small.real, small.fake.drop("A"))
    with pytest.raises(TypeError):
        nested = spark.createDataFrame([([1],)], "v array<int>")
        TablePair.of(nested, nested)


def test_impute_and_sample(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (float("nan"), "b")], "x double, s string")
    p = TablePair.of(df, df).imputed()
    assert sorted(p.real.collect(), key=str) == sorted([(1.0, "a"), (1.0, MISSING), (1.0, "b")], key=str)
    assert TablePair.of(df, df).sampled(2).real.count() == 2
    with pytest.raises(ValueError):
        TablePair.of(df, df).sampled(4)


def test_js_golden(spark):
    p = numbers(spark, [20.0, 25.0, 30.0, 35.0, 40.0], [22.0, 27.0, 32.0, 37.0, 42.0])
    assert dist.js_distance(p).first()["js_distance"] == pytest.approx(0.2736453208486386, abs=1e-15)


def test_distances_of_equal_and_shifted_sides(spark):
    rng = np.random.default_rng(0)
    x = [float(v) for v in rng.normal(size=500)]
    same, moved = numbers(spark, x, x), numbers(spark, x, [v + 3 for v in x])
    assert dist.ks(same).first()["statistic"] == 0
    assert dist.ks(same).first()["equality"] == "identical"
    for p in (1, 2):
        assert dist.wasserstein_1d(same, p=p).first()["distance"] == pytest.approx(0, abs=1e-9)
        assert dist.wasserstein_1d(moved, p=p).first()["distance"] == pytest.approx(3)
    assert dist.ks(moved).first()["equality"] == "different"
    assert dist.transport_cost(same).first()["cost"] == 0
    assert dist.transport_cost(moved).first()["cost"] == pytest.approx(3, abs=0.3)
    with pytest.raises(Exception, match="infinite"):
        dist.wasserstein_1d(numbers(spark, [1.0, float("inf")], [1.0])).collect()


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_two_level_ecdf(spark, ranges):
    rng = np.random.default_rng(ranges)
    a, b = rng.integers(0, 40, 300), rng.integers(5, 60, 200)
    with session(spark, ranges):
        rows = dist.ecdf(numbers(spark, [float(x) for x in a], [float(x) for x in b]).long()).orderBy("value").collect()
    values = sorted({*a.tolist(), *b.tolist()})
    assert [r.value for r in rows] == values
    for r, after in zip(rows, [*values[1:], None], strict=True):
        assert (r.cr, r.cf, r.nr, r.nf, r.nxt) == ((a <= r.value).sum(), (b <= r.value).sum(), 300, 200, after)


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_pieces_of_two_quantile_functions(spark, ranges):
    rng = np.random.default_rng(ranges)
    a, b = rng.integers(0, 30, 90).astype(float), rng.normal(10, 5, 60).round(0)
    with session(spark, ranges):
        pair = numbers(spark, a.tolist(), b.tolist())
        ranked = [(r.width, r.x, r.y) for r in dist.pieces_of(pair, by_rank=True).collect()]
        got = dist.wasserstein_1d(pair, p=2).first()["distance"]
    a, b = np.sort(a), np.sort(b)
    want = Counter(zip(a[:60], b, strict=True))
    found = Counter()
    for w, x, y in ranked:
        found[x, y] += int(w)
    assert found == want
    assert got == pytest.approx(math.sqrt(np.mean((np.repeat(a, 2) - np.repeat(b, 3)) ** 2)))


def test_quantile_pairing_keeps_its_digits(spark):
    """Epoch milliseconds within seconds: raw second moments would lose all of them."""
    rng = np.random.default_rng(5)
    a, b = 1.7e12 + rng.integers(0, 3600, 500), 1.7e12 + rng.integers(0, 90, 500) ** 2
    got = assoc.column_correlations(numbers(spark, a.tolist(), b.tolist())).first()["correlation"]
    x, y = np.sort(a) - 1.7e12, np.sort(b) - 1.7e12
    assert got == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


def test_category_pairing_is_row_by_row(spark):
    rng = np.random.default_rng(6)
    make = lambda n: sorted(zip(rng.choice(list("abc"), n).tolist(), rng.choice(list("xyz"), n).tolist(), strict=True))
    real, fake = make(70), make(50)
    pair = TablePair.of(*(spark.createDataFrame(rows, "p string, q string") for rows in (real, fake)))
    for ranges in (1, 5):
        with session(spark, ranges):
            got = {r.column: r.correlation for r in assoc.column_correlations(pair).collect()}
        rows = spark.createDataFrame([(a[0], b[0], a[1], b[1]) for a, b in zip(real, fake, strict=False)], "p string, p2 string, q string, q2 string")
        want = {r.col_a: r.value for r in assoc.theils_u(rows, [("p", "p2"), ("q", "q2")]).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_measures_of_a_pair_share_one_table(spark):
    pair = numbers(spark, [1.0, 2.0, 4.0], [1.0, 3.0])
    dist.ks(pair).collect()
    table = pair.kept["ecdf", pair.numerical]
    dist.wasserstein_1d(pair, p=2).collect()
    basic.statistics_vector(pair).collect()
    assert pair.kept["ecdf", pair.numerical] is table
    assert not pair.sampled(2).kept


def test_medians_are_exact(spark):
    for a, b in (([1.0, 2.0, 4.0, 10.0], [3.0]), ([5.0, 5.0, 1.0], [2.0, 8.0])):
        rows = {r.statistic: (r.real, r.fake) for r in basic.statistics_vector(numbers(spark, a, b)).collect()}
        assert rows["median"] == (np.median(a), np.median(b))


def test_wasserstein_2_of_unequal_sizes(spark):
    rng = np.random.default_rng(2)
    a, b = np.sort(rng.normal(size=60)), np.sort(rng.exponential(size=40))
    want = math.sqrt(np.mean((np.repeat(a, 2) - np.repeat(b, 3)) ** 2))
    assert dist.wasserstein_1d(numbers(spark, a.tolist(), b.tolist()), p=2).first()["distance"] == pytest.approx(want)


def test_constant_and_null_columns(spark):
    p = numbers(spark, [1.0, 1.0, None], [1.0, None, None])
    assert dist.ks(p).first()["statistic"] == 0
    assert dist.js_distance(p).first()["js_distance"] == 0
    assert dist.wasserstein_1d(p).first()["distance"] == 0
    assert viz.histogram(p).count() == 1


def test_sinkhorn(spark):
    x = np.random.default_rng(0).normal(size=(80, 2))
    near, ok = dist.sinkhorn(x, x, reg=0.01, max_iter=5000)
    far, _ = dist.sinkhorn(x, x + 5, reg=0.01, max_iter=5000)
    assert near < 0.2 and far == pytest.approx(50, rel=0.05)
    # the same by products of matrices and in the log domain
    y = np.random.default_rng(1).normal(1, 2, size=(60, 2))
    cost = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    plain, ok = dist.sinkhorn(x, y)
    f, g, k = np.zeros(80), np.zeros(60), -cost / (0.1 * cost.mean())
    for _ in range(1000):
        f = -np.log(80) - np.log(np.exp(k + g).sum(axis=1))
        g = -np.log(60) - np.log(np.exp(k + f[:, None]).sum(axis=0))
    assert ok and plain == pytest.approx((np.exp(k + f[:, None] + g) * cost).sum(), rel=1e-4)


def test_transport_plan_moves_all_at_the_cost(spark):
    rng = np.random.default_rng(4)
    pair = numbers(spark, rng.normal(size=200).tolist(), rng.exponential(size=150).tolist())
    plan = dist.transport_plan(pair).collect()
    assert sum(r.mass for r in plan) == pytest.approx(1)
    assert sum(r.cost for r in plan) == pytest.approx(dist.transport_cost(pair).first()["cost"])


def test_density(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=300), rng.normal(1, 2, size=200)
    rows = viz.density(numbers(spark, a.tolist(), b.tolist()), points=60).orderBy("at").collect()
    kde = lambda x, at: np.mean(np.exp(-0.5 * ((at - x) / (x.std(ddof=1) * len(x) ** -0.2)) ** 2)) / (x.std(ddof=1) * len(x) ** -0.2 * math.sqrt(2 * math.pi))
    assert len(rows) == 60
    for r in rows:
        assert r.real == pytest.approx(kde(a, r.at), abs=2e-4) and r.fake == pytest.approx(kde(b, r.at), abs=2e-4)


def test_associations(spark):
    rows = [(a, b, float(i), None if i == 3 else c) for i, (a, b, c) in enumerate([("x", "p", "k"), ("x", "p", "k"), ("y", "q", "k"), ("y", "q", "k"), ("z", "q", "k")] * 10)]
    df = spark.createDataFrame(rows, "a string, b string, n double, c string")
    m = {(r.col_a, r.col_b): r.value for r in assoc.associations(df).collect()}
    assert len(m) == 16 and all(m[k, k] == 1 for k in "abnc")
    assert m["a", "b"] == m["b", "a"] and m["a", "c"] == 0 and 0 <= m["a", "n"] <= 1
    u = {(r.col_a, r.col_b): r.value for r in assoc.theils_u(df, [("a", "b"), ("b", "a"), ("c", "a")]).collect()}
    assert u["b", "a"] == pytest.approx(1) and 0 < u["a", "b"] < 1 and u["c", "a"] == 0
    assert assoc.cramers_v(df, [("a", "b")], bias_correction=False).first()["value"] == pytest.approx(1)
    for how in ("pearson", "spearman", "kendall"):
        assert assoc.associations(spark.createDataFrame([(i, i * i, 7) for i in range(20)], "a int, b int, k int"), num_num=how).where("col_a = 'k' and col_b = 'a'").first()["value"] == 0


def test_rank_correlations(spark):
    df = spark.createDataFrame([(float(i % 7), float((i * i) % 11)) for i in range(60)], "a double, b double")
    a, b = zip(*df.collect(), strict=True)
    assert assoc.spearman(df, [("a", "b")]).first()["value"] == pytest.approx(abs(basic.spearmanr(a, b)))
    assert assoc.kendall(df, [("a", "b")]).first()["value"] == pytest.approx(abs(basic.kendalltau(a, b)))


def test_kendall_takes_all_rows(spark):
    rnd = np.random.default_rng(3)
    a = np.append(rnd.integers(0, 900, 2500), [7] * 500).astype(float)
    b = np.round(a / 9 + rnd.normal(0, 30, 3000), 1)
    b[-1], a[0] = 1e300, -1e300
    df = spark.createDataFrame(list(zip(a.tolist(), (-b).tolist(), strict=True)) + [(None, 1.0), (1.0, None)], "a double, b double")
    want = basic.kendalltau(a, -b)
    for how in ({}, {"leaf_rows": 100}):
        out = {r.col_a: r.value for r in assoc.kendall(df, [("a", "b"), ("b", "a")], absolute=False, **how).collect()}
        assert out == {"a": pytest.approx(want, abs=1e-12), "b": pytest.approx(want, abs=1e-12)}
    assert assoc.kendall(df.limit(0), [("a", "b")]).count() == 0


def test_trees_have_one_depth_at_every_size():
    for name in ("DecisionTreeClassifier", "RandomForestClassifier"):
        assert {ml.classifiers(n, 3, 2)[name].getMaxDepth() for n in (10, 999, 1_000, 10**6)} == {ml.MAX_DEPTH}


def test_self_comparison_is_perfect(spark, small):
    own = TablePair.of(small.real, small.real)
    assert all(r.correlation == pytest.approx(1) for r in assoc.column_correlations(own).collect())
    assert assoc.correlation_distance(own, "rmse").first()["distance"] == 0
    assert basic.basic_statistical_evaluation(own) == pytest.approx(1)
    assert basic.pca_correlation(own) == pytest.approx(1)


def test_quantile_pairing(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 50).astype(float), rng.integers(0, 5, 50).astype(float)
    got = assoc.column_correlations(numbers(spark, a.tolist(), b.tolist())).first()["correlation"]
    assert got == pytest.approx(np.corrcoef(np.sort(a), np.sort(b))[0, 1])


def test_copies_and_duplicates(spark, small):
    assert privacy.copies_count(TablePair.of(small.real, small.real)).first()["copied"] == 5
    assert privacy.copies(TablePair.of(small.real, small.real)).count() == 5
    assert privacy.copies_count(small).first()["copied"] == 0
    assert tuple(privacy.duplicates_count(small).first()) == (0, 0)
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 2)], "s string, n int")
    p = TablePair.of(df, df)
    assert tuple(privacy.duplicates_count(p).first()) == (2, 2)
    assert privacy.duplicates(df).count() == 2
    assert privacy.copies(p).count() == 3 and privacy.novel_rows(p).count() == 0


def test_k_anonymity_edges(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "q string, s int")
    r = privacy.k_anonymity(df, ["q"]).first()
    assert (r.k, r.classes, r.mean_size, r.violations, r.level) == (1, 2, 1.5, 2, "Poor")
    assert privacy.k_anonymity(df, []).first()["level"] == "Error"
    assert tuple(privacy.l_diversity(df, ["q"], "s").first()) == (1, 1.5, 1)


def test_nearest_row(spark):
    p = numbers(spark, [0.0, 10.0], [1.0, 13.0])
    assert tuple(privacy.row_distance(p).first()) == (2.0, 1.0, 2)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(700, 2)), rng.normal(size=(300, 2))
    make = lambda x: spark.createDataFrame(x.tolist(), "a double, b double")
    near = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
    got = privacy.row_distance(TablePair.of(make(a), make(b))).first()
    assert tuple(got) == (pytest.approx(near.mean()), pytest.approx(near.std()), 700)


def test_nearest_row_of_all_rows(spark):
    """More rows than any sample held: all look, and in all."""
    real = spark.range(30_000).selectExpr("cast(id as double) as x", "cast(0 as double) as z")
    fake = spark.range(25_000).selectExpr("cast(id as double) as x", "cast(3 as double) as z")
    gaps = np.sqrt(9 + np.maximum(np.arange(30_000) - 24_999.0, 0) ** 2)
    got = privacy.row_distance(TablePair.of(real, fake)).first()
    assert tuple(got) == (pytest.approx(gaps.mean(), rel=1e-12), pytest.approx(gaps.std(), rel=1e-9), 30_000)


def test_the_privacy_report_looks_at_all_rows(spark):
    df = spark.range(21_000).selectExpr("cast(id % 3 as string) as q", "cast(id as double) as x")
    found, _ = privacy.privacy_evaluation(TablePair.of(df, df.selectExpr("q", "x + 0.5 as x")), ["q"], membership=False)
    assert tuple(found["row_distance"].first()) == (0.5, 0.0, 21_000)


def test_nearest_row_by_cells(spark):
    """Cells give what all pairs give: clusters, ties on a column, copies, points far off, missing values, and a cell that most rows look in."""
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.normal(size=(400, 3)), rng.normal(size=(300, 3)) * 50, np.full((200, 3), 2.0), rng.integers(0, 3, (200, 3))])
    b = np.concatenate([rng.normal(size=(500, 3)), rng.integers(0, 3, (300, 3)), [[1e9, -1e9, 0.0]], np.column_stack([np.zeros(200), np.zeros(200), np.arange(200)])])
    make = lambda x: spark.createDataFrame([*x.tolist(), (None, 0.0, 0.0)], "a double, b double, c double")
    near = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
    got = nearest.nearest(make(a), make(b), ["a", "b", "c"], held=10, cell_points=16, group_rows=50).collect()
    assert np.sort(np.repeat([r.d for r in got], [r.n for r in got])) == pytest.approx(np.sort(near))


def test_a_row_that_fills_the_table(spark):
    """Groups larger than a task's share are written out by several."""
    df = spark.range(200_000).selectExpr("'x' as a", "cast(null as int) as b")
    pair = TablePair.of(df.unionByName(spark.createDataFrame([("y", 1)], df.schema)), df.unionByName(spark.createDataFrame([("z", 1)], df.schema)))
    assert privacy.copies(pair).count() == 200_000
    assert [tuple(r) for r in privacy.novel_rows(pair).collect()] == [("z", 1)]
    assert {tuple(r) for r in privacy.duplicates(pair.real).distinct().collect()} == {("x", None, 200_000)} and privacy.duplicates(pair.real).count() == 200_000


def test_a_part_that_fails_at_run_time_leaves_the_others(spark):
    df = spark.range(40).selectExpr("id % 4 as a", "cast(id as double) as x")
    bad = df.withColumn("x", F.when(F.col("x") >= 0, F.raise_error(F.lit("broken"))).cast("double"))
    found, _ = privacy.privacy_evaluation(TablePair.of(df, bad, cat_cols=["a"]), ["a"], membership=False)
    assert "error" in found["row_distance"].columns and "broken" in found["row_distance"].first()["error"]
    assert found["k_anonymity"].first()["k"] == 10


def test_many_categories(spark):
    df = spark.range(200_000).select(F.format_string("v%06d", (F.col("id") * 7919) % 200_000).alias("c"))
    pair = encode.factorize(TablePair.of(df, spark.createDataFrame([("v000007",), (None,), ("zz",)], "c string")))
    assert sorted(r.c for r in pair.fake.where("c is not null").collect()) == [7, 200_000]
    assert pair.real.agg(F.countDistinct("c"), F.min("c"), F.max("c")).first() == (200_000, 0, 199_999)
    assert "v0" not in pair.real._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        encode.one_hot(TablePair.of(df, df))


def test_rbf_kernel(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(60, 2)), rng.normal(4, 1, size=(45, 2))
    make = lambda v: spark.createDataFrame(v.tolist(), "a double, b double")
    d2 = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(axis=2)
    scale = lambda *m: 1 / (2 * np.median(np.concatenate([np.sqrt(x[x > 0]) for x in m])) ** 2)
    pair = TablePair.of(make(x), make(y))

    def want(a, b, gammas):
        k = [np.exp(-g * m) for g, m in zip(gammas, (d2(a, a), d2(b, b), d2(a, b)), strict=True)]
        return max(0, (k[0].sum() - 60) / (60 * 59) + (k[1].sum() - 45) / (45 * 44) - 2 * k[2].mean())

    all_three = (d2(x, x), d2(y, y), d2(x, y))
    got = kernel.mmd_rbf(pair, gamma=0.3).first()
    assert (got.mmd_squared, got.n_real, got.n_fake) == (pytest.approx(want(x, y, [0.3] * 3)), 60, 45) and got.mmd_squared > 0.1
    assert kernel.mmd_rbf(pair, gamma="pooled").first().mmd_squared == pytest.approx(want(x, y, [scale(*all_three)] * 3))
    assert kernel.mmd_rbf(pair).first().mmd_squared == pytest.approx(want(x, y, [scale(m) for m in all_three]))
    each = {r.column: r.mmd_squared for r in kernel.mmd_column_wise(pair, gamma=0.3).collect()}
    assert each == {c: pytest.approx(want(x[:, [i]], y[:, [i]], [0.3] * 3)) for i, c in enumerate("ab")}


def test_classifiers_are_as_stated():
    own = ml.classifiers(1000, 3, 2)["LogisticRegression"]
    assert own.getMaxIter() == 500 and not own.getStandardization()


def test_train_test_on_synthetic(spark):
    rows = [(float(i % 10), float(i % 7), "hi" if i % 10 > 4 else "lo") for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    turned = df.withColumn("y", F.when(F.col("y") == "hi", "lo").otherwise("hi"))
    same = ml.train_test_on_synthetic(TablePair.of(df, df), "y").first()
    assert (same.metric, same.ratio, same.difference) == ("accuracy", 1.0, 0.0)
    wrong = ml.train_test_on_synthetic(TablePair.of(df, turned), "y").first()
    assert wrong.synthetic_score == 0 and wrong.difference == 1
    assert {r.metric for r in ml.train_test_on_synthetic(TablePair.of(df, df), "b", "regression").collect()} == {"mse", "mae", "r2"}


def test_text_columns_that_fail_have_an_error(spark):
    df = spark.createDataFrame([("hello world", "a b"), ("good day", "c d")], "t string, u string")
    bad = df.withColumn("u", F.when(F.length("u") > 0, F.raise_error(F.lit("broken"))).cast("string"))
    report = FidelityReport(TablePair.of(df, bad, text_cols=["t", "u"]))
    rows = {r.column: r for r in report.text()[0].collect()}
    assert rows["t"].error is None and rows["t"].overall is not None
    assert "broken" in rows["u"].error and rows["u"].overall is None
    summary = report.text_summary().first()
    assert (summary.type, summary.columns) == ("text", 1) and "broken" in summary.error


def test_codes_of_values_that_share_their_beginnings(spark):
    """Digests and heads give the places that whole values have: one the beginning of another, equal for 64 and for 1024 characters, not ASCII."""
    a = "x" * 64
    values = [a, a + "b", a + "a", "x" * 1024, "x" * 1024 + "c", "x" * 20_000 + "z", "x" * 20_000 + "y", "", "é", "z", "\U0001f600", "\uffff", None, a]
    df = spark.createDataFrame([(v, str(i % 3)) for i, v in enumerate(values)], "t string, u string")
    places = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=lambda v: v.encode()))}
    got = encode.coded(df.withColumn("whole", F.col("t")), ["t", "u"]).collect()
    assert len(got) == len(values) and Counter((r.whole, r.t, r.u) for r in got) == Counter((v, places.get(v), i % 3) for i, v in enumerate(values))


def test_a_report_moves_no_whole_texts(spark):
    """Measures compare texts by digests and read them from one table: what is shuffled is far smaller than the texts."""
    rows = spark.range(300).selectExpr("id", "id % 7 as n", "int(id % 2) as y", "concat_ws('', transform(sequence(1, 400), i -> sha2(concat_ws('-', id % 290, i), 256))) as t").localCheckpoint()
    side = lambda k: rows.where(F.floor(F.col("id") % 4 / 2) == k).join(rows.select("id", "t").limit(0), ["id", "t"], "left_anti").select("n", "y", "t")
    pair = TablePair.of(side(0), side(1), text_cols=["t"])
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    report = FidelityReport(pair, Settings(estimators=("DecisionTreeClassifier",)))
    got = {(r.section, r.metric): r.value for r in report.evaluate("y").collect()}
    size = 300 * 400 * 64
    assert written() - before < size / 10
    assert got["privacy", "real_duplicates"] == privacy.duplicates_count(pair).first()[0] and got["privacy", "copied"] == privacy.copies_count(pair).first()["copied"]
    assert got["statistics", "correlation_correlation"] == pytest.approx(assoc.correlation_correlation(pair).first()[0])


def test_corpus_statistics_and_five_scores(spark):
    pair = texts(spark, ["one two three", "", None], ["one"])
    rows = {r.side: r for r in text.corpus_statistics(pair, "t").collect()}
    assert (rows[1].n_texts, rows[1].n_empty, rows[1].vocabulary_size, rows[1].mean_words) == (2, 2, 3, 1.5)
    assert (rows[0].n_texts, rows[0].vocabulary_size) == (1, 1)
    row = text.text_similarity(texts(spark, ["hello world", "test it"], ["hello world", "test it"]), "t").first()
    assert tuple(row) == (1, 1, 1, pytest.approx(1), pytest.approx(1))
    p = text.length_similarity(texts(spark, [], []), "t").first()
    assert (p.p_value, p.significant) == (0, True)


def test_encodings(spark, small):
    p = encode.factorize(small)
    assert [r.B for r in p.real.orderBy("A").collect()] == [0, 1, 2, 3, 4]
    assert [r.B for r in p.fake.orderBy("A").collect()] == [0, 1, 2, 3, 5]
    hot = encode.one_hot(small)
    assert hot.real.columns == sorted(hot.real.columns) and "B_f" in hot.real.columns
    assert one(hot.real.agg(F.sum("B_f"))) == 0
    numeric, info = encode.numeric_encoding(small)
    assert info == {"B": "one_hot", "D": "factorized"} and numeric.real.columns == numeric.fake.columns


@pytest.mark.parametrize("degree", [1, 3])
def test_mmd_moments_are_the_pairwise_sums(spark, degree):
    rng = np.random.default_rng(degree)
    x, y = rng.normal(size=30), rng.normal(1, 1, size=25)
    c0 = 0.0 if degree == 1 else 1.0
    k = lambda a, b: (np.outer(a, b) + c0) ** degree
    n, m = len(x), len(y)
    want = (k(x, x).sum() - np.diag(k(x, x)).sum()) / (n * (n - 1)) + (k(y, y).sum() - np.diag(k(y, y)).sum()) / (m * (m - 1)) - 2 * k(x, y).mean()
    p = numbers(spark, x.tolist(), y.tolist())
    got = (kernel.mmd_linear(p) if degree == 1 else kernel.mmd_polynomial(p)).first()["mmd_squared"]
    assert got == pytest.approx(max(0, want), rel=1e-9)
    joint = kernel.mmd_multivariate(p, kernel="linear" if degree == 1 else "polynomial").first()["mmd_squared"]
    assert joint == pytest.approx(max(0, want), rel=1e-9)


def test_custom_kernel(spark):
    p = numbers(spark, [1.0, 2.0, 3.0], [4.0, 5.0])
    assert kernel.mmd_custom(p, scalar.dot).first()[0] == pytest.approx(kernel.mmd_linear(p).first()["mmd_squared"])


def test_text_edges(spark):
    same = texts(spark, ["hello world", "test message"], ["hello world", "test message"])
    v = text.vocabulary_overlap(same, "t").first()
    assert v.jaccard == 1 and v.diversity_ratio == 1
    assert text.tfidf_similarity(same, "t").first()["cosine"] == pytest.approx(1)
    v = text.vocabulary_overlap(texts(spark, ["cat dog"], ["bird fish"]), "t").first()
    assert v.jaccard == 0 and v.shared == 0
    empty = texts(spark, [], [])
    assert text.length_similarity(empty, "t").first()["ks_statistic"] == 1
    assert tuple(text.tfidf_similarity(empty, "t").first())[:2] == (0, 1)
    assert text.vocabulary_overlap(empty, "t").first()["jaccard"] == 1
    nulls = texts(spark, ["hello world", None, "test message", ""], ["hello world", "sample text", None, "test"])
    assert text.lexical_similarity(nulls, "t").first()["rating"] in ratings.LEXICAL.labels + ("Very Poor",)


def test_ratings():
    assert ratings.WASSERSTEIN.of(0.05) == "Excellent" and ratings.WASSERSTEIN.of(2) == "Very Poor"
    assert ratings.K_ANONYMITY.of(2) == "Weak" and ratings.ATTACK_RISK.of(0.75) == "Medium"
    assert ratings.MMD.of(float("nan")) == "Unknown"


def test_metric_registry():
    assert basic.metric(lambda a, b: (0.5, 0.1))([1], [2]) == 0.5
    with pytest.raises(ValueError):
        basic.metric("nothing")
    x, y = [1.0, 2.0, 3.0, 4.0], [1.0, 3.0, 2.0, 4.0]
    assert basic.metric("linregress")(x, y) == pytest.approx(0.8)
    assert basic.metric("somersd")(x, y) == pytest.approx(4 / 6)
    assert basic.metric("weightedtau")(x, x) == 1 and basic.metric("weightedtau")(x, x[::-1]) == -1
    assert basic.metric("weightedtau")([12, 2, 1, 12, 2], [1, 4, 7, 1, 0]) == pytest.approx(-0.56694968)


def test_loading(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b,c\n1,x,2.5\n2,y,3.5\n")
    (tmp_path / "f.csv").write_text("c;a\n1.5;7\n")
    real, fake = load_csv_pair(spark, f"{tmp_path}/r.csv", f"{tmp_path}/f.csv", fake_sep=";")
    assert real.columns == fake.columns == ["c", "a"] and fake.dtypes == real.dtypes
    real, fake = align_loaded(spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("2", "y")], "p string, q string"))
    assert fake.first() == (2, "y")
    with pytest.raises(ValueError):
        align_loaded(real, fake.select("a").withColumnRenamed("a", "z"))
    assert len(write_report({"x": real}, f"{tmp_path}/out")) == 1


def test_targets(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 3), None) for i in range(100)], "id int, c string, k double, gone string")
    assert [(r.column, r.task) for r in ml.target_columns(df).collect()] == [("c", "classification"), ("k", "classification"), ("id", "regression")]
    assert ml.detect_task(df, "c") == "classification" and ml.detect_task(df, "id") == "regression"


def test_estimators_on_equal_sides(spark):
    rows = [(float(i % 10), float(i % 7), "hi" if i % 10 > 4 else "lo") for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    p = TablePair.of(df, df)
    assert ml.estimator_evaluation(p, "y", estimators=["DecisionTreeClassifier"]) == pytest.approx(1)
    scores = ml.estimator_scores(p, "a", "regr", estimators=["Ridge"]).collect()
    assert all(r.trained_on_real == pytest.approx(r.trained_on_fake) for r in scores)


def test_report(spark, small):
    with pytest.raises(ValueError):
        Settings(text_weight=2)
    with pytest.raises(ValueError):
        FidelityReport(small).evaluate("nothing")
    parts, advice = FidelityReport(small).privacy(membership=False)
    assert "risk" in parts and advice
    assert "rating" in FidelityReport(small).wasserstein(include_2d=True).columns
    assert FidelityReport(small, Settings(n_samples_distance=3)).size_notes()
    assert FidelityReport(small).row_distance().count() == 1
    assert set(FidelityReport(small).plots()) >= {"mean_std", "cumulative", "histogram", "categories"}


def test_streaming_moments(spark, tmp_path):
    from twinscope.streaming.incremental import running_histogram, running_moments

    rows = spark.createDataFrame([(i % 2, float(i)) for i in range(20)], "side int, x double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, df in (("moments", running_moments(stream, ["x"])), ("bins", running_histogram(stream, "x", [0, 5, 10]))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    assert {(r.side, r.n, r["mean"]) for r in spark.table("moments").collect()} == {(0, 10, 9.0), (1, 10, 10.0)}
    assert sum(r.real + r.fake for r in spark.table("bins").collect()) == 20
