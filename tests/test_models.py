"""Splits, metrics, attributions and stored models."""

from itertools import combinations
from math import exp, factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import scoring, training
from ledgerlark.plans import checks
from ledgerlark.plans.lineage import cut, run_dir, scratch_path
from ledgerlark.plans.tables import tables
from ledgerlark.schemas import MODEL_FEATURES, PREDICTIONS

SMALL = {"trees": 6, "depth": 3, "rate": 0.1, "min_child": 2}


@pytest.fixture(scope="module")
def modeling(spark):
    return tables(spark, "/root/testdata/sf0.01").modeling


@pytest.fixture(scope="module")
def split(modeling):
    return cut(training.stratified_split(modeling))


@pytest.fixture(scope="module")
def model(split):
    return training.train_boosted(split.where(~F.col("is_test")), SMALL)


def test_split_sizes(split):
    for row in split.groupBy("churned").agg(F.count("*").alias("n"), F.count_if("is_test").alias("test")).collect():
        assert row.test == -(-row.n // 5)


def test_folds_are_balanced(split):
    folded = training.stratified_kfold(split)
    for label in (0, 1):
        sizes = [row["count"] for row in folded.where(F.col("churned") == label).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_auc_equals_pair_counting(spark):
    draw = np.random.default_rng(5)
    for digits in (1, 6):
        scores = draw.random(300).round(digits)
        labels = (draw.random(300) < 0.4).astype(int)
        frame = spark.createDataFrame(
            [(float(s), int(y), int(s > 0.5), i % 2) for i, (s, y) in enumerate(zip(scores, labels))],
            "churn_probability double, churned int, prediction int, part int",
        )

        def brute(mask):
            pos, neg = scores[mask & (labels == 1)], scores[mask & (labels == 0)]
            wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
            return wins / (len(pos) * len(neg))

        everything = np.ones(300, dtype=bool)
        assert training.binary_metrics(frame).first().roc_auc == pytest.approx(brute(everything), abs=1e-12)
        for row in training.binary_metrics(frame, "part").collect():
            assert row.roc_auc == pytest.approx(brute(np.arange(300) % 2 == row.part), abs=1e-12)


def test_metrics_without_positive_predictions(spark):
    frame = spark.createDataFrame([(0.1, 1, 0), (0.2, 0, 0)], "churn_probability double, churned int, prediction int")
    row = training.binary_metrics(frame).first()
    assert (row.precision, row.recall, row.f1_score, row.accuracy) == (0.0, 0.0, 0.0, 0.5)
    assert [tuple(r) for r in training.confusion_matrix(frame).collect()] == [(0, 1, 0), (1, 1, 0)]


def test_attributions_add_up_to_the_margin(modeling, model):
    explained = scoring.attributions(modeling, model)
    sums = explained.groupBy("customer_id").agg((F.sum("shap_value") + F.max("base_value")).alias("log_odds"))
    both = sums.join(training.predict(model, modeling), "customer_id").collect()
    assert len(both) == modeling.count()
    for row in both[:200]:
        assert 1 / (1 + exp(-row.log_odds)) == pytest.approx(row.churn_probability, abs=1e-6)


def test_attributions_equal_brute_force(modeling, model, split):
    """Shapley values by their definition, with the tree's own conditional expectation; nulls imputed, or a value of their own."""
    with_nulls = training.train_boosted(split.where(~F.col("is_test")), SMALL, impute=False)

    def expectation(tree, node, row, known):
        if tree.feature[node] < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        value = row[tree.feature[node]]
        if tree.feature[node] in known:
            goes_left = tree.null_left[node] if np.isnan(value) else value <= tree.threshold[node]
            return expectation(tree, left if goes_left else right, row, known)
        return sum(expectation(tree, child, row, known) * tree.cover[child] / tree.cover[node] for child in (left, right))

    everyone = range(len(MODEL_FEATURES))
    some = modeling.where("average_order_gap is null").limit(2).unionByName(modeling.orderBy("customer_id").limit(2))
    for fitted in (model, with_nulls):
        inputs = fitted.prepare(some).select(*[f"model_{c}" for c in MODEL_FEATURES]).collect()
        rows = np.array([[np.nan if v is None else v for v in r] for r in inputs])
        found = scoring.shapley_values(scoring.leaf_tables(fitted), rows, len(MODEL_FEATURES))
        for i, row in enumerate(rows):
            def value(known):
                return sum(expectation(tree, 0, row, known) for tree in fitted.trees)

            for j in everyone:
                others = [f for f in everyone if f != j]
                total = 0.0
                for size in range(len(others) + 1):
                    weight = factorial(size) * factorial(len(others) - size) / factorial(len(others) + 1)
                    for known in combinations(others, size):
                        total += weight * (value({*known, j}) - value(set(known)))
                assert found[i, j] == pytest.approx(total, abs=1e-9)
    assert np.isnan(rows).any()


@pytest.mark.parametrize("depth", [3, 5])
def test_tabled_attributions_equal_those_by_leaves(modeling, split, depth):
    """Looked up by the outcomes of splits, trees of more splits than a table holds included."""
    fitted = training.train_boosted(split.where(~F.col("is_test")), {**SMALL, "depth": depth, "min_child": 1}, impute=False)
    inputs = fitted.prepare(modeling).select(*[f"model_{c}" for c in MODEL_FEATURES]).toPandas().to_numpy(dtype=float)
    rows, wide = np.vstack([inputs, np.full((1, inputs.shape[1]), np.nan)]), len(MODEL_FEATURES)
    tables, by_leaf = scoring.outcome_tables(fitted.trees, wide), scoring.leaf_tables(fitted)
    assert len(tables) >= len(fitted.trees) and all(len(splits) <= scoring.TABLE_SPLITS for splits, _ in tables)
    assert depth == 3 or len(tables) > len(fitted.trees)
    assert np.abs(scoring.tabled_values(tables, rows, wide) - scoring.shapley_values(by_leaf, rows, wide)).max() < 1e-12


def test_lookup_computes_attributions_once(spark, modeling, model):
    """Both driver lists come from one evaluation, and hold what ``top_drivers`` and ``protective_factors`` find."""
    attr = scoring.attributions(modeling, model)
    lists = scoring._driver_lists(attr)
    assert lists._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    found = {r.customer_id: r for r in lists.collect()}
    assert len(found) == modeling.count()
    for name, ranked in (("churn_drivers", scoring.top_drivers(attr)), ("protective_factors", scoring.protective_factors(attr))):
        wanted = {}
        for r in ranked.orderBy("customer_id", "position").collect():
            wanted.setdefault(r.customer_id, []).append((r.position, r.feature, r.feature_value, r.shap_value))
        assert {c: [tuple(e) for e in r[name]] for c, r in found.items() if r[name] is not None} == wanted
    none = attr.where("customer_id < 100").withColumn("shap_value", F.when(F.col("feature") == "frequency", 0.0))
    assert all(r.churn_drivers is None and r.protective_factors is None for r in scoring._driver_lists(none).collect())


def test_importance_sums_to_one(spark, model):
    rows = training.feature_importance(spark, model).collect()
    assert len(rows) == 8 and sum(row.importance for row in rows) == pytest.approx(1.0)


def test_scores_are_consistent(modeling, model):
    scored = scoring.score_customers(modeling, model, "2001-08-01 00:00:00")
    assert [(f.name, f.dataType) for f in scored.schema] == [(f.name, f.dataType) for f in PREDICTIONS]
    assert scored.where("churn_probability < 0 OR churn_probability > 1").count() == 0
    with pytest.raises(ValueError):
        scoring.score_customers(modeling.limit(0), model, "2001-08-01 00:00:00")


def test_risk_edges(spark):
    frame = spark.createDataFrame([(0.0,), (0.499999,), (0.5,), (0.749999,), (0.75,), (1.0,), (None,)], "churn_probability double")
    levels = [row.risk_level for row in scoring.risk_level(frame).collect()]
    assert levels == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", None]


def test_saved_model_scores_the_same(spark, modeling, model):
    path = scratch_path(spark, "model")
    training.save_model(spark, model, path)
    row = scoring.prediction_roundtrip(modeling, model, training.load_model(spark, path)).first()
    assert row.max_probability_difference == 0.0 and row.class_differences == 0
    with pytest.raises(FileNotFoundError):
        training.load_model(spark, path + "-missing")


def test_sweeps_report_every_configuration(split):
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    configs = {"one": {**SMALL, "trees": 2}, "two": {**SMALL, "trees": 3, "depth": 2}}
    rows = training.config_sweep(train, test, configs).collect()
    assert {row.model for row in rows} == {"one", "two"}
    assert all(row.gap == row.train_auc - row.test_auc for row in rows)
    summary = training.cv_config_sweep(training.stratified_kfold(train), 3, configs).collect()
    assert {row.model for row in summary} == {"one", "two"}
    assert all(0 <= row.cv_auc_mean <= 1 and row.cv_auc_std >= 0 for row in summary)


def test_forest_with_few_trees(split):
    model = training.train_random_forest(split.where(~F.col("is_test")), trees=3, depth=4)
    row = training.binary_metrics(training.predict(model, split.where("is_test"))).first()
    assert 0 <= row.roc_auc <= 1


def test_forest_rows_are_shared_by_tasks(split, monkeypatch):
    train, seen = split.where(~F.col("is_test")), []
    monkeypatch.setattr(training, "FOREST_TASK_ROWS", -(-train.count() // 4))
    monkeypatch.setattr(training, "_fit", lambda rows, expressions, classifier: seen.append((rows, classifier)))
    training.train_random_forest(train, trees=3, depth=4)
    rows, classifier = seen[0]
    assert rows.rdd.getNumPartitions() == 4 and classifier.getCacheNodeIds()
    assert rows.exceptAll(train).count() == 0 and rows.count() == train.count()


def test_small_trees_pass_the_checks(split, model):
    train, test = split.where(~F.col("is_test")).drop("is_test"), split.where(F.col("is_test")).drop("is_test")
    forest = training.train_random_forest(train, trees=8, depth=6, min_rows_per_leaf=3)
    for fitted, trees, depth in ((model, SMALL["trees"], SMALL["depth"]), (forest, 8, 6)):
        row = checks.tree_model(split, fitted, trees, depth).first()
        assert row.auc_holds and row.size_holds
        assert row.train_churned + row.train_active == train.count()
        assert row.beats_share
    assert not checks.tree_model(split, forest, 8, 2).first().size_holds
    configs = {"a": {**SMALL, "trees": 2}, "b": {**SMALL, "trees": 3, "depth": 2}}
    swept = checks.sweep(training.config_sweep(train, test, configs, {"a": model}), train, test).collect()
    assert {(row.model, row.train_rows, row.test_rows, row.bounded) for row in swept} == {(name, train.count(), test.count(), True) for name in "ab"}
    folded = training.stratified_kfold(train, 2)
    found = checks.folds(training.cv_folds(folded, 2, configs), folded).collect()
    assert len(found) == 4 and all(row.bounded and row.train_rows + row.held_out_rows == train.count() for row in found)


def test_gradient_check_sees_an_unfinished_fit(split):
    train = split.where(~F.col("is_test")).drop("is_test")
    assert checks.stationary(train, training.train_logistic(train))
    assert not checks.stationary(train, training.train_logistic(train, max_iter=1))


def test_runs_keep_to_one_folder(spark):
    assert scratch_path(spark, "a").startswith(run_dir(spark) + "/a-")
