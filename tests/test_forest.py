"""Random forests: growth by brute force, every row, any size of nodes and any deal of rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ledgerlark.functions import ranking
from ledgerlark.operators import forest, training
from ledgerlark.plans.lineage import scratch_path
from ledgerlark.schemas import MODEL_FEATURES


def _made_up(spark, rows, partitions=4):
    """Rows whose features differ and whose label follows some of them, with some noise."""
    noise = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)).cast("int").alias(name) for k, name in enumerate(MODEL_FEATURES)]
    table = spark.range(0, rows, 1, partitions).select(F.col("id").alias("customer_id"), *noise)
    first, second = MODEL_FEATURES[:2]
    odd = F.pmod(F.xxhash64("customer_id"), F.lit(10)) == 0
    return table.withColumn("churned", ((F.col(first) + F.col(second) > 900) != odd).cast("int"))


def _probabilities(model, rows):
    return {row.customer_id: row.churn_probability for row in training.predict(model, rows).collect()}


def _naive(codes, drawn, labels, node, picks_of, least, depth):
    """The nodes below ``node`` as (id, feature, bin) or (id, share) one by one."""
    rows, ones = drawn.sum(), (drawn * labels).sum()
    best = (0.0, None, None)
    if node.bit_length() - 1 < depth:
        for feature in picks_of(node):
            for bound in np.unique(codes[:, feature]):
                left = codes[:, feature] <= bound
                n, k = drawn[left].sum(), (drawn * labels)[left].sum()
                if min(n, rows - n) >= least:
                    win = float(k * rows - ones * n) ** 2 / (float(n) * (rows - n))
                    if win > best[0]:
                        best = (win, feature, bound)
    if best[1] is None:
        return [(node, ones / rows)]
    left = codes[:, best[1]] <= best[2]
    return [(node, best[1], best[2])] + [
        entry
        for side, child in ((left, 2 * node), (~left, 2 * node + 1))
        for entry in _naive(codes[side], drawn[side], labels[side], child, picks_of, least, depth)
    ]


@pytest.mark.parametrize(("rows", "least", "depth"), [(300, 1, 30), (300, 5, 4), (2, 1, 30)])
def test_growth_by_brute_force(rows, least, depth):
    draw = np.random.default_rng(3)
    codes, labels = draw.integers(0, 12, (rows, 5)).astype(np.uint8), (np.arange(rows) % 2).astype(np.uint8)
    drawn = draw.integers(1, 4, rows).astype(np.uint8)
    kinds, cuts, values, deepest, gains = forest.grown(codes, drawn << 1 | labels, 1, 7, 0, 3, least, depth, 0)
    found, ids, inner, leaf = [], [1], iter(cuts.tolist()), iter(values.tolist())
    for kind, node in zip(kinds.tolist(), ids):  # level by level
        if kind >= 0:
            found.append((node, kind, next(inner)))
            ids += [2 * node, 2 * node + 1]
        else:
            found.append((node, next(leaf) / forest.UNIT))
    expected = _naive(codes, drawn.astype(int), labels.astype(int), 1, lambda node: forest.picked(np.array([node]), 7, 0, 5, 3)[0], least, depth)
    assert sorted(entry[:1] for entry in found) == sorted(entry[:1] for entry in expected)
    for mine, other in zip(sorted(found), sorted(expected)):
        assert mine == other if len(mine) == 3 else mine[1] == pytest.approx(other[1], abs=1e-9)
    assert deepest == max(ids).bit_length() - 1 and (gains > 0).any()


def test_weights_are_poisson():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64) * np.uint64(2)
    for tree in range(3):
        drawn = forest.weights(hashes, 42, tree)
        assert drawn.mean() == pytest.approx(1, abs=0.02) and drawn.var() == pytest.approx(1, abs=0.03)
    assert (forest.weights(hashes, 42, 0) != forest.weights(hashes, 42, 1)).mean() > 0.5


def test_forest_sees_rows_of_the_last_hashes(spark):
    """The fit once read 200,000 rows in hash order only."""
    rows = spark.range(0, 220_000, 1, 8).select(F.col("id").alias("customer_id"))
    hashed = ranking.portable_hash(F.col("customer_id"), training.SEED)
    bound = rows.select(hashed.alias("h")).orderBy("h").offset(200_000).first().h
    last = hashed >= bound
    values = [F.when(last, 500).otherwise(F.col("customer_id") % 10).alias(name) for name in MODEL_FEATURES]
    rows = rows.select("customer_id", last.cast("int").alias("churned"), *values)
    model = training.train_random_forest(rows, trees=3, depth=3)
    means = {row.churned: row.p for row in training.predict(model, rows).groupBy("churned").agg(F.avg("churn_probability").alias("p")).collect()}
    assert means[1] > 0.99 and means[0] < 0.01


def test_trees_depend_neither_on_large_nodes_nor_on_partitions(spark, monkeypatch):
    rows = _made_up(spark, 1500)
    whole = training.train_random_forest(rows, trees=4, depth=12)
    monkeypatch.setattr(forest, "NODE_ROWS", 100)
    monkeypatch.setattr(training, "FOREST_TASK_ROWS", 200)
    monkeypatch.setattr(forest, "SCORED_ROWS", 400)
    parts = training.train_random_forest(rows.repartition(7), trees=4, depth=12)
    assert whole.stages[-1].pieces.count() == 4 < parts.stages[-1].pieces.count()
    assert [(t.depth, t.numNodes) for t in whole.stages[-1].trees] == [(t.depth, t.numNodes) for t in parts.stages[-1].trees]
    assert _probabilities(whole, rows) == _probabilities(parts, rows)
    assert np.allclose(whole.stages[-1].featureImportances.toArray(), parts.stages[-1].featureImportances.toArray())


def test_forest_learns_and_is_saved(spark):
    rows = _made_up(spark, 3000)
    fitted, other = rows.where("customer_id < 2000"), rows.where("customer_id >= 2000")
    model = training.train_random_forest(fitted, trees=30)
    assert training.binary_metrics(training.predict(model, other)).first().roc_auc > 0.8
    assert model.stages[-1].getNumTrees == 30 and all(0 < tree.depth <= 30 for tree in model.stages[-1].trees)
    weights = {row.feature: row.importance for row in training.feature_importance(spark, model).collect()}
    assert sum(weights.values()) == pytest.approx(1) and min(weights[name] for name in MODEL_FEATURES[:2]) > max(weights[name] for name in MODEL_FEATURES[2:])
    path = scratch_path(spark, "forest-model")
    training.save_model(spark, model, path)
    loaded = training.load_model(spark, path)
    assert isinstance(loaded, PipelineModel) and _probabilities(loaded, other) == _probabilities(model, other)


def test_twice_the_same_row_is_scored_twice(spark):
    rows = _made_up(spark, 200)
    model = training.train_random_forest(rows, trees=2, depth=3)
    scored = training.predict(model, rows.unionByName(rows).withColumn("customer_id", F.lit(None).cast("bigint")))
    assert scored.count() == 400
    assert training.predict(model, rows.limit(0)).count() == 0


def test_refused_fits(spark):
    rows = _made_up(spark, 20)
    with pytest.raises(ValueError, match="labels 0 and 1"):
        training.train_random_forest(rows.withColumn("churned", F.lit(2)), trees=2, depth=2)
    with pytest.raises(ValueError, match="does not follow"):
        forest.ForestClassifier(subsamplingRate=0.5).fit(rows)
