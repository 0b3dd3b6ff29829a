"""Boosted trees against a plain growth over all rows, and their distributed forms."""

import pickle

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from ledgerlark.operators import boosting, training
from ledgerlark.plans.lineage import cut
from ledgerlark.plans.tables import tables
from ledgerlark.schemas import MODEL_FEATURES

NAMES = ["a", "b", "c"]
CONFIG = {"trees": 8, "depth": 3, "rate": 0.3, "min_child": 4}


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)
    a, b = draw.integers(0, 400, 500).astype(float), draw.normal(size=500).round(2)
    c = np.where(draw.random(500) < 0.3, np.nan, draw.integers(0, 5, 500))
    label = ((a > 200) ^ (b > 0.3) | np.isnan(c)) & (draw.random(500) < 0.9)
    return a, b, c, label.astype(int)


@pytest.fixture(scope="module")
def table(spark, rows):
    a, b, c, label = rows
    found = [(k, float(a[k]), float(b[k]), None if np.isnan(c[k]) else float(c[k]), int(label[k])) for k in range(500)]
    return cut(spark.createDataFrame(found, "customer_id long, a double, b double, c double, churned int").repartition(7))


def hashed(k, seed=42):
    return ((k % 2**31) * 2654435761 + seed) % 2**32


def plain(rows, config):
    """The same model by loops: exact bounds, whole gradients, every split of every node tried."""
    matrix, label = np.column_stack(rows[:3]), rows[3]
    n = len(label)
    bounds = []
    for k in range(3):
        values = np.sort(matrix[~np.isnan(matrix[:, k]), k])
        tops = {}
        for value in values:
            upto = int((values <= value).sum())
            tops[-(-upto * boosting.BINS // len(values))] = value
        bounds.append(sorted(tops.values())[:-1])
    base = float(np.log(label.mean() / (1 - label.mean())))
    margin, trees = np.full(n, base), []
    for number in range(config["trees"]):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - label) * boosting.UNIT), np.rint(p * (1 - p) * boosting.UNIT)
        factor, offset = boosting.row_sample(number)
        sampled = np.array([(hashed(k) * factor + offset) % 2**32 < int(0.8 * 2**32) for k in range(n)])
        columns = boosting.tree_columns(config, number, 3, 42)

        def leaf(members):
            return -config["rate"] * (g[members].sum() / boosting.UNIT) / (h[members].sum() / boosting.UNIT + 1.0)

        def score(members):
            return (g[members].sum() / boosting.UNIT) ** 2 / (h[members].sum() / boosting.UNIT + 1.0)

        def grow(members, depth):
            used = members & sampled
            best = None
            if depth:
                for k in columns:
                    null = np.isnan(matrix[:, k])
                    for null_left in (True, False):
                        for bound in [*bounds[k], np.inf]:
                            left = np.where(null, null_left, matrix[:, k] <= bound)
                            sides = used & left, used & ~left
                            if min(h[side].sum() / boosting.UNIT for side in sides) < config["min_child"]:
                                continue
                            gain = score(sides[0]) + score(sides[1]) - score(used)
                            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, k, bound, null_left, left)
            if best is None:
                margin_change[members] = leaf(used)
                return leaf(used)
            _, k, bound, null_left, left = best
            return (k, bound, null_left, grow(members & left, depth - 1), grow(members & ~left, depth - 1))

        margin_change = np.zeros(n)
        trees.append(grow(np.ones(n, dtype=bool), config["depth"]))
        margin = margin + margin_change
    return margin, trees


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    return (tree.feature[node], tree.threshold[node], tree.null_left[node], nested(tree, tree.left[node]), nested(tree, tree.right[node]))


def alike(left, right):
    if isinstance(left, tuple) != isinstance(right, tuple):
        return False
    if not isinstance(left, tuple):
        return left == pytest.approx(right, abs=1e-9)
    return left[:3] == right[:3] and alike(left[3], right[3]) and alike(left[4], right[4])


def model(base, trees):
    return boosting.BoostedModel({name: name for name in NAMES}, base, trees)


def test_equals_plain_growth(rows, table):
    margin, trees = plain(rows, CONFIG)
    base, found = boosting.fit_boosted({"x": table}, {"y": CONFIG}, NAMES)["x", "y"]
    assert len(found) == len(trees) and all(alike(nested(tree), other) for tree, other in zip(found, trees))
    assert model(base, found).margins(np.column_stack(rows[:3])) == pytest.approx(margin, abs=1e-9)
    assert any(2 in tree.feature for tree in found)


def test_same_trees_however_rows_are_dealt(table, monkeypatch):
    whole = boosting.fit_boosted({"x": table}, {"y": CONFIG}, NAMES)["x", "y"]
    monkeypatch.setattr(boosting, "STORED_EVERY", 3)
    for dealt in (table.repartition(5), table.orderBy("a")):
        base, trees = boosting.fit_boosted({"x": dealt}, {"y": CONFIG}, NAMES, task_rows=100)["x", "y"]
        assert (base, [nested(tree) for tree in trees]) == (whole[0], [nested(tree) for tree in whole[1]])


def test_fits_in_lockstep_equal_fits_alone(table):
    parts = {"even": table.where("customer_id % 2 = 0"), "most": table.where("customer_id > 80")}
    configs = {"deep": CONFIG, "flat": {**CONFIG, "depth": 1, "trees": 5}, "heavy": {**CONFIG, "min_child": 30, "trees": 3}}
    together = boosting.fit_boosted(parts, configs, NAMES, task_rows=150)
    for (part, config), (base, trees) in together.items():
        alone = boosting.fit_boosted({"x": parts[part]}, {"y": configs[config]}, NAMES)["x", "y"]
        assert (base, [nested(t) for t in trees]) == (alone[0], [nested(t) for t in alone[1]])
    assert all(len(tree.value) == 3 or len(tree.value) == 1 for tree in together["most", "flat"][1])
    for tree in together["most", "heavy"][1]:
        assert all(cover >= 30 for cover, feature in zip(tree.cover[1:], tree.feature[1:]))


def test_scores_in_stages(spark, rows, table):
    fitted = model(*boosting.fit_boosted({"x": table}, {"y": CONFIG}, NAMES)["x", "y"])
    stored = boosting.BoostedModel.of_text(fitted.text())
    scored = {r.customer_id: r for r in stored.transform(table).collect()}
    staged = {(r.customer_id, r.trees): r.churn_probability for r in fitted.staged(table, [0, 3, 8]).collect()}
    for k, row in scored.items():
        assert staged[k, 8] == row.probability[1] == 1 - row.probability[0] or abs(staged[k, 8] - row.probability[1]) < 1e-15
        assert row.prediction == float(row.probability[1] > 0.5)
    first = {r.customer_id: r.probability[1] for r in fitted.first(3).transform(table).collect()}
    assert all(staged[k, 3] == first[k] for k in first)
    assert sum(fitted.importances()) == pytest.approx(1.0)


def test_prefixes_share_a_fit(spark):
    split = tables(spark, "/root/testdata/sf0.001").split
    train = split.where("not is_test")
    short, long = {**CONFIG, "trees": 2}, {**CONFIG, "trees": 6}
    models = training.boost_all({"x": train}, {"short": short, "long": long})
    alone = training.train_boosted(train, short)
    assert [nested(t) for t in models["x", "short"].trees] == [nested(t) for t in alone.trees]
    found = {r.trees: r.roc_auc for r in training.staged_auc(models["x", "long"], split, [2, 6]).collect()}
    for trees, name in ((2, "short"), (6, "long")):
        assert found[trees] == training.binary_metrics(training.predict(models["x", name], split)).first().roc_auc


def test_degenerate_tables(spark, table):
    empty = table.where("false")
    with pytest.raises(ValueError):
        boosting.fit_boosted({"x": empty}, {"y": CONFIG}, NAMES)
    constant = table.withColumns({"a": F.lit(1.0), "b": F.lit(None).cast("double"), "c": F.lit(2.0)})
    base, trees = boosting.fit_boosted({"x": constant}, {"y": CONFIG}, NAMES)["x", "y"]
    assert all(len(tree.value) == 1 for tree in trees)
    one = table.withColumn("churned", F.lit(1))
    base, trees = boosting.fit_boosted({"x": one}, {"y": CONFIG}, NAMES)["x", "y"]
    assert base > 10 and all(len(tree.value) == 1 for tree in trees)


def test_features_of_the_study_are_numeric(spark):
    edges = boosting.bin_edges(tables(spark, "/root/testdata/sf0.001").modeling, MODEL_FEATURES)
    assert all(list(v) == sorted(set(v)) and len(v) < boosting.BINS for v in edges.values())


def test_only_choices_reach_the_driver(table, monkeypatch):
    """Tasks that share a fit send the driver splits, not histograms, and the trees stay the same."""
    sent, collect = [], RDD.collect

    def measured(self):
        found = collect(self)
        sent.append(len(pickle.dumps(found)))
        return found

    alone = boosting.fit_boosted({"x": table}, {"y": CONFIG}, NAMES)["x", "y"]
    monkeypatch.setattr(RDD, "collect", measured)
    shared = boosting.fit_boosted({"x": table.repartition(4)}, {"y": CONFIG}, NAMES, task_rows=125)["x", "y"]
    assert [nested(t) for t in shared[1]] == [nested(t) for t in alone[1]]
    assert sent and max(sent) < 3 * 256 * 8
