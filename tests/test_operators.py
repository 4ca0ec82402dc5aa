import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave import queries
from riskweave.operators import binning, clean, cohort, evaluation, features, genomics, models, plots, selection
from riskweave.plans.fixtures import frame

SMALL = "/root/testdata/sf0.001"


def _scores(spark, values):
    return spark.createDataFrame([(i, "m", float(v)) for i, v in enumerate(values)], "iid long, model string, v double")


@pytest.mark.parametrize("kind", ["plain", "low", "high", "middle", "equal", "few"])
@pytest.mark.parametrize("n", [10, 100])
def test_quantile_bins_like_pandas(spark, kind, n):
    r = np.random.default_rng(3)
    x = r.normal(size=300).round(2)
    x = {"plain": x, "low": np.maximum(x, -0.5), "high": np.minimum(x, 0.5), "middle": np.where(abs(x) < 0.6, 0, x), "equal": x * 0 + 1, "few": x.round(0)}[kind]
    got = binning.qcut(_scores(spark, x), "v", n, ["model"]).orderBy("iid").toPandas()["bin"].to_numpy()
    if kind == "equal":
        assert (got == 1).all()
    else:
        want = pd.qcut(pd.Series(x), n, labels=False, duplicates="drop").to_numpy() + 1
        assert (got == want).all()


def test_transfer_clamps(spark):
    edges = binning.quantile_edges(_scores(spark, range(101)), "v", 10, ["model"])
    got = binning.transfer(_scores(spark, [-5, 0, 10, 10.5, 100, 900]), edges, "v", ["model"]).orderBy("iid").toPandas()["bin"]
    assert got.tolist() == [1, 1, 1, 2, 10, 10]


def test_hard_call_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.699,), (0.7,), (1.0,), (1.7,), (2.0,), (None,)], "raw double")
    assert [r[0] for r in df.select(clean.hard_call(F.col("raw"))).collect()] == [0, 0, 1, 1, 2, 2, None]


def test_pair_null_rules(spark):
    g = spark.createDataFrame([(1, 1, None), (1, 2, 2), (2, 1, None), (3, 1, 1), (3, 2, 2), (4, 2, 1)], "iid long, snp long, dosage long")
    pairs = spark.createDataFrame([("1,2",), ("2",)], "feature string")
    rows = lambda **k: {(r["iid"], r["feature"]): r["x"] for r in features.pair_features(g, pairs, **k).collect()}
    assert rows() == {(1, "1,2"): 2, (2, "1,2"): 0, (3, "1,2"): 3, (4, "1,2"): 1, (1, "2"): 2, (3, "2"): 2, (4, "2"): 1}
    assert rows(how="prod") == {(1, "1,2"): 2, (2, "1,2"): 0, (3, "1,2"): 2, (1, "2"): 2, (3, "2"): 2, (4, "2"): 1}
    assert rows(propagate_null=True)[(1, "1,2")] is None


def test_no_cases_is_an_error(spark):
    with pytest.raises(ValueError):
        cohort.validate_cases(spark.createDataFrame([(1, 1)], "iid long, phenotype int"))


def test_auc_of_negated_scores(spark):
    rows = spark.createDataFrame([(i, "m", int(i % 3 == 0), float(i * 7 % 11)) for i in range(50)], "iid long, model string, y int, v double")
    a, b = (evaluation.rank_auc(rows.withColumn("v", F.col("v") * s), "v", ["model"]).head()["auc"] for s in (1, -1))
    assert a + b == pytest.approx(1)


def test_delong_by_double_loop(spark):
    r = np.random.default_rng(1)
    y, s = r.integers(0, 2, 40), r.integers(0, 6, (40, 2))
    rows = spark.createDataFrame([(int(i), m, int(y[i]), float(s[i, k])) for i in range(40) for k, m in enumerate("ab")], "iid long, model string, y int, v double")
    got = evaluation.delong(rows, "v", [("a", "b")]).head()
    psi = lambda k: np.array([[(p > q) + 0.5 * (p == q) for q in s[y == 0, k]] for p in s[y == 1, k]])
    one, two = psi(0), psi(1)
    cov = lambda u, w: np.cov(u.mean(1), w.mean(1))[0, 1] / len(u) + np.cov(u.mean(0), w.mean(0))[0, 1] / u.shape[1]
    assert got["auc1"] == pytest.approx(one.mean()) and got["auc2"] == pytest.approx(two.mean())
    assert got["var1"] == pytest.approx(cov(one, one)) and got["cov"] == pytest.approx(cov(one, two))


def _sweep(variants, linked, reach):
    """Window after window over all variants, pair after pair until nothing goes."""
    kept, order = set(variants), sorted(variants)
    for first in order:
        while True:
            window = [v for v in order if v in kept and first <= v <= first + reach]
            pair = next(((a, b) for i, a in enumerate(window) for b in window[i + 1 :] if (a, b) in linked), None)
            if pair is None:
                break
            kept.discard(pair[0] if variants[pair[0]] < variants[pair[1]] else pair[1])
    return sorted(kept)


def test_window_prune(spark):
    r = random.Random(3)
    for n, m, reach in ((4, 3, 50), (60, 150, 90), (60, 400, 12), (60, 400, 300), (40, 0, 5)):
        variants = {x: r.randint(1, 6) for x in r.sample(range(-50, 400), n)}
        linked = {tuple(sorted(r.sample(sorted(variants), 2))) for _ in range(m)}
        rows = [(b, a, 0.9) if i % 2 else (a, b, 0.9) for i, (a, b) in enumerate(linked)] + [(*sorted(variants)[:2], 0.3)]
        edges = spark.createDataFrame(rows, "snp_a long, snp_b long, r2 double")
        got = genomics.window_prune(spark.createDataFrame(list(variants.items()), "snp long, minor long"), edges, reach)
        assert sorted(x["snp"] for x in got.collect()) == _sweep(variants, linked, reach)


@pytest.mark.parametrize("pivots", [1, 3, 4096])
def test_exact_neighbours(spark, monkeypatch, pivots):
    from riskweave.operators import neighbours

    monkeypatch.setattr(neighbours, "MOST_PIVOTS", pivots)
    r = np.random.default_rng(pivots)
    make = lambda n, start: [(start + i, *map(float, p), float(t)) for i, (p, t) in enumerate(zip(np.concatenate([r.integers(0, 5, (n // 2, 2)), r.normal(size=(n - n // 2, 2)) * 3]), r.integers(0, 9, n), strict=True))]
    train, asked = make(300, 0), make(80, 1000)
    known = spark.createDataFrame([*train, (5000, None, 1.0, 2.0), (5001, 1.0, 1.0, None)], "iid long, a double, b double, t double")
    rows = spark.createDataFrame([*((i, a, b, None) for i, a, b, _ in asked), (7000, None, 1.0, None), (7001, 1.0, 1.0, 77.0)], "iid long, a double, b double, t double")
    for k in (1, 4, 500):
        got = {x["iid"]: x["t"] for x in neighbours.knn_impute(known, rows, "t", ["a", "b"], k).collect()}
        for i, a, b, _ in asked:
            best = sorted((np.sqrt((a - x) ** 2 + (b - y) ** 2), t) for _, x, y, t in train)[:k]
            assert got[i] == pytest.approx(np.mean([t for _, t in best]))
        assert got[7000] is None and got[7001] == 77.0 and len(got) == 82
    assert neighbours.knn_impute(known.limit(0), rows, "t", ["a", "b"]).filter("t is null").count() == 81


def test_quantiles_and_midranks(spark):
    from riskweave.operators.binning import quantiles
    from riskweave.operators.evaluation import midranks

    r = random.Random(5)
    rows = [(g, float(r.choice((0.0, 1.5, -2.0, r.gauss(0, 1e3)))) if r.random() > 0.1 else None, i) for i in range(900) for g in ("a", "b")] + [("one", 4.0, 0)]
    df = spark.createDataFrame(rows, "g string, x double, iid long")
    for points in (20, 2500, [0.0, 0.025, 0.5, 1.0]):  # also more points than values
        for got in quantiles(df, "x", points, ["g"]).collect():
            own = [x for g, x, _ in rows if g == got["g"] and x is not None]
            want = np.quantile(own, [k / points for k in range(points + 1)] if isinstance(points, int) else points)
            assert np.allclose(got["q"], want)
    whole = quantiles(df, "x", [0.5], []).head()["q"][0]
    assert whole == pytest.approx(np.median([x for _, x, _ in rows if x is not None]))
    ranked = midranks(df.filter("g <> 'one'").na.drop(), "x", ["g"], "rank").toPandas()
    assert np.allclose(ranked["rank"], ranked.groupby("g")["x"].rank())


def test_joins_that_must_find_everybody(spark):
    from riskweave.operators import assembly, cohort

    people = spark.createDataFrame([(1, 2), (2, 1)], "iid long, phenotype int")
    assert assembly.strict_labels(people.select("iid"), people).count() == 2
    with pytest.raises(KeyError):
        assembly.strict_labels(spark.range(4).select(F.col("id").alias("iid")), people)
    with pytest.warns(UserWarning):
        assert cohort.validate_cases(people) == 1
    with pytest.raises(ValueError):
        cohort.validate_cases(people.filter("phenotype = 1"))


def test_dropped_models(spark):
    rows = spark.createDataFrame([("main", "epi", 0.7, 0.6, 0.4), ("main", "epi+main", 0.7, 0.9, 0.4), ("epi", "cardio", 0.5, 0.9, 0.01)], "model1 string, model2 string, auc1 double, auc2 double, p double")
    assert {r[0] for r in selection.dropped_models(rows).collect()} == {"epi", "epi+main"}


def test_imputation_by_forest(spark):
    train = spark.createDataFrame([(i, float(i), float(i * 2)) for i in range(100)], "iid long, a double, t double")
    rows = spark.createDataFrame([(1, 50.0, None), (2, 10.0, 7.0)], "iid long, a double, t double")
    got = {r["iid"]: r["t"] for r in models.forest_impute(train, rows, "t", ["a"]).collect()}
    assert abs(got[1] - 100) < 20 and got[2] == 7.0


def test_imputation_fits_each_column_once(spark, monkeypatch):
    """What is known and what is wanted are filled by one forest."""
    from pyspark.ml.regression import RandomForestRegressor

    fits, fit = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, data: fits.append(self.getLabelCol()) or fit(self, data))
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else float(i), None if i % 5 == 0 else float(2 * i)) for i in range(60)], "iid long, a double, b double")
    got = models.iterative_impute(rows.filter("iid < 50"), rows, ["a", "b"], rounds=1, trees=3).collect()
    assert fits == ["a", "b"] and len(got) == 60 and all(r["a"] is not None and r["b"] is not None for r in got)


def test_clinical_imputation_has_all_rounds_and_trees(spark, monkeypatch):
    """Ten rounds of a hundred trees for each measure that somebody lacks, as in the reference; a column that nobody lacks has no forest."""
    from pyspark.ml.regression import RandomForestRegressor

    fits, fit = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, data: fits.append((self.getLabelCol(), self.getNumTrees())) or fit(self.copy({self.numTrees: 2}), data))
    got = queries.QUERIES["iterative_clinical_imputation"](spark, SMALL)
    assert fits == [("marker", 100)] * 10  # at this size nobody lacks the others
    people = got.toPandas()
    assert len(people) == frame(spark, SMALL, "clinical").count() and not people.isna().any().any()
    fits.clear()
    rows = spark.createDataFrame([(i, float(i), None if i % 5 == 0 else float(2 * i)) for i in range(60)], "iid long, a double, b double")
    models.iterative_impute(rows, rows, ["a", "b"], rounds=2, trees=3)
    assert fits == [("b", 3)] * 2


def test_imputation_in_rounds(spark):
    r = np.random.default_rng(4)
    a = r.normal(size=300)
    make = lambda start, none: spark.createDataFrame([(start + i, float(x), None if i % none == 0 else float(2 * x), float(-x) if i % 7 else None) for i, x in enumerate(a)], "iid long, a double, b double, c double")
    got = models.iterative_impute(make(0, 11), make(1000, 5), ["a", "b", "c"], rounds=2, trees=5).toPandas().sort_values("iid")
    assert not got.isna().any().any() and np.abs(got["b"].to_numpy() - 2 * a)[::5].mean() < 0.5 * np.abs(2 * a)[::5].mean()


def test_mixed_score_finds_the_informative_one(spark):
    r = np.random.default_rng(2)
    a, b = r.normal(size=(2, 400))
    y = (a + 0.3 * r.normal(size=400) > 0).astype(int)
    rows = [(i, int(y[i]) + 1, m, float(v)) for i in range(400) for m, v in (("a", a[i]), ("b", b[i]))]
    scores = spark.createDataFrame(rows, "iid long, phenotype int, model string, scaled_prs double")
    fit = models.mixed_score(scores, ["a", "b"], replicates=20)
    got = {x["model"]: x for x in fit.collect()}
    assert got["a"]["t"] > 4 > got["b"]["t"] and got["a"]["ci_low"] <= got["a"]["beta"] <= got["a"]["ci_high"]
    assert models.apply_mix(scores, fit).count() == 400


def test_plot_data(spark):
    rows = spark.createDataFrame([(i, "m", float(i % 10), 1 + i % 2) for i in range(100)], "iid long, model string, v double, phenotype int")
    h = plots.histogram(rows, "v", 5, ["model"]).toPandas()
    assert len(h) == 5 and h["cases"].sum() == 50 and h["controls"].sum() == 50
    assert plots.box(rows, "v", ["model"]).head()["median"] == 4.5


def test_tree_shap_by_enumeration(spark):
    import itertools
    import math

    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.feature import VectorAssembler

    from riskweave.operators import tree_shap as T

    r = np.random.default_rng(5)
    x = r.normal(size=(200, 3))
    y = np.where(x[:, 0] > 0, x[:, 1], x[:, 2] * 2) + (x[:, 0] > 1)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(200)], "iid long, a double, b double, c double, label double")
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = RandomForestRegressor(numTrees=2, maxDepth=4, seed=1).fit(data)
    trees = T.flatten(model)

    def value(tree, row, known, at=0):
        f, t, left, right, v, cover = tree[at]
        if f < 0:
            return v
        if f in known:
            return value(tree, row, known, left if row[f] <= t else right)
        return sum(value(tree, row, known, k) * tree[k][5] for k in (left, right)) / cover

    got = {(q["iid"], q["feature"]): q["shap"] for q in T.tree_shap(model, data.limit(5), ["a", "b", "c"]).collect()}
    for i in sorted({k[0] for k in got}):
        for j, name in enumerate("abc"):
            rest, want = [k for k in range(3) if k != j], 0.0
            for n in range(3):
                for s in itertools.combinations(rest, n):
                    w = math.factorial(n) * math.factorial(2 - n) / math.factorial(3)
                    want += w * sum(value(t, x[i], {*s, j}) - value(t, x[i], set(s)) for t in trees) / len(trees)
            assert got[i, name] == pytest.approx(want, abs=1e-9)


def test_failed_batches_say_why(spark):
    rows = spark.createDataFrame([(1, "a", 1.0)], "iid long, feature string, x double")
    catalogue = spark.createDataFrame([(0, "a"), (1, "b")], "batch long, feature string")

    def fit(rows, people, names):
        if names == ["b"]:
            raise ValueError("no such thing")
        return spark.createDataFrame([(n, 1.0) for n in names], "feature string, coefs double")

    got = {r["batch"]: r["status"] for r in models.fit_batches(rows, rows, catalogue, fit).collect()}
    assert got == {0: "ok", 1: "no such thing"}


def test_a_batch_that_takes_too_long(spark):
    catalogue = spark.createDataFrame([(0, "a"), (1, "b")], "batch long, feature string")
    rows = spark.createDataFrame([(1,)], "iid long")

    def fit(rows, people, names):
        n = 10 if names == ["a"] else 10**14
        return spark.range(0, n, 1, 1).selectExpr("sum(hash(id)) as coefs").selectExpr("'x' as feature", "cast(coefs as double) as coefs")

    got = {r["batch"]: r["status"] for r in models.fit_batches(rows, rows, catalogue, fit, seconds=4.0).collect()}
    assert got == {0: "ok", 1: "timeout"}


def test_feature_sets():
    parts = {"main": ["a"], "epi": ["a,b"], "cardio": ["e,a,b"], "hla": ["h"], "env_main": ["e"], "clinical": ["c"], "covariate": ["age"]}
    one, two = models.feature_sets(parts), models.feature_sets(parts, separate_hla=True)
    assert one["main"] == ["a", "h", "age"] and two["main"] == ["a", "age"] and two["hla"] == ["h", "age"]
    assert one["all+env_main+clinical_main"][-3:] == ["e", "c", "age"] and one["covariate"] == ["age"]


def test_quantiles_between_equal_values_are_that_value(spark, duck):
    """0.216599 at 3/10 of 1408 rows would be 0.21659899999999999 as a weighted sum, and rows that equal the edge would lie above it."""
    values = [0.1] * 300 + [0.216599] * 700 + [0.9] * 408
    rows = spark.createDataFrame([("m", x) for x in values], "model string, p double")
    [want] = duck.sql(f"SELECT quantile_cont(x, {[i / 10 for i in range(11)]}) FROM (SELECT unnest(CAST({values} AS DOUBLE[])) AS x)").fetchall()
    assert binning.quantiles(rows, "p", 10, ["model"]).first()["q"] == want[0]
    got = {(r["p"], r["bin"]) for r in binning.qcut(rows, "p", 10, ["model"]).select("p", "bin").distinct().collect()}
    assert got == {(0.1, 1), (0.216599, 1), (0.9, 2)}
