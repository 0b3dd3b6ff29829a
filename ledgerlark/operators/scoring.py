"""Scoring customers and explaining the scores."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.operators.training import predict
from ledgerlark.schemas import MODEL_FEATURES, PROBABILITY

#: Splits whose outcomes are tabled together; trees that are deeper are explained leaf by leaf.
TABLE_SPLITS = 8

# Risk bounds and the recommended action per risk level.
MEDIUM_FROM = 0.50
HIGH_FROM = 0.75
RECOMMENDATIONS = {
    "HIGH": "Prioritize this customer for a retention or reactivation campaign.",
    "MEDIUM": "Monitor this customer and consider a targeted engagement campaign.",
    "LOW": "Continue regular engagement; no immediate retention intervention is required.",
}


def risk_level(df, probability="churn_probability"):
    """LOW below 0.50, MEDIUM below 0.75, HIGH from there; unknown stays null."""
    p = F.col(probability)
    level = F.when(p >= HIGH_FROM, "HIGH").when(p >= MEDIUM_FROM, "MEDIUM").when(p.isNotNull(), "LOW")
    return df.withColumn("risk_level", level)


def recommendation(df):
    """The action text of each risk level."""
    texts = F.create_map(*[F.lit(part) for pair in RECOMMENDATIONS.items() for part in pair])
    return df.withColumn("recommendation", texts[F.col("risk_level")])


def score_customers(modeling, model, scored_at):
    """One prediction per modelling customer. Risk follows from the unrounded
    probability, which is then stored with six decimals."""
    if modeling.isEmpty():
        raise ValueError("no customer features found")
    scored = risk_level(predict(model, modeling.select("customer_id", *MODEL_FEATURES)))
    return scored.select(
        "customer_id",
        F.col("churn_probability").cast(PROBABILITY).alias("churn_probability"),
        F.col("prediction").cast("tinyint").alias("prediction"),
        "risk_level",
        F.lit(scored_at).cast("timestamp_ntz").alias("prediction_date"),
    )


# ---- attribution ---------------------------------------------------------------


def _leaves(tree, node=0, bounds=None):
    """(value, {feature: (low, high, null, share)}) for every leaf below ``node``: the interval each
    path feature must lie in, whether a null follows the path, and the share of the training
    weight (hessian sums) that follows it when that feature is unknown."""
    bounds = bounds or {}
    if tree.feature[node] < 0:
        yield tree.value[node], bounds
        return
    feature, threshold = tree.feature[node], tree.threshold[node]
    low, high, null, share = bounds.get(feature, (-np.inf, np.inf, True, 1.0))
    for child, interval, takes_null in (
        (tree.left[node], (low, min(high, threshold)), tree.null_left[node]),
        (tree.right[node], (max(low, threshold), high), not tree.null_left[node]),
    ):
        part = share * tree.cover[child] / tree.cover[node]
        yield from _leaves(tree, child, {**bounds, feature: (*interval, null and takes_null, part)})


def _paths(tree, node=0, path=()):
    """(value, ((split, whether it goes left), ...)) for every leaf below ``node``."""
    if tree.feature[node] < 0:
        yield tree.value[node], path
        return
    yield from _paths(tree, tree.left[node], (*path, (node, True)))
    yield from _paths(tree, tree.right[node], (*path, (node, False)))


def leaf_tables(model, trees=None):
    """Leaves of a boosted model, or of some of its trees, as arrays, grouped by how many features their path uses."""
    grouped = {}
    for tree in model.trees if trees is None else trees:
        for value, bounds in _leaves(tree):
            grouped.setdefault(len(bounds), []).append((value, sorted(bounds.items())))
    tables = {}
    for size, leaves in grouped.items():
        def column(k, leaves=leaves, size=size):
            return np.array([[b[k] for _, b in path] for _, path in leaves]).reshape(len(leaves), size)

        tables[size] = {
            "value": np.array([value for value, _ in leaves]),
            "feature": np.array([[f for f, _ in path] for _, path in leaves], dtype=int).reshape(len(leaves), size),
            "low": column(0),
            "high": column(1),
            "null": column(2).astype(bool),
            "share": column(3),
        }
    return tables


def base_value(model, tables):
    """Mean log-odds over the training weight: the attribution of knowing nothing."""
    return model.base + float(sum((t["value"] * t["share"].prod(axis=1)).sum() for t in tables.values()))


def _effects(value, inside, share):
    """A leaf's Shapley value of each feature on its path, the last axis of ``inside`` and ``share``."""
    size = share.shape[-1]
    for j in range(size):
        others = [i for i in range(size) if i != j]
        weight = np.zeros(inside.shape[:-1])
        for taken in range(size):
            factor = factorial(taken) * factorial(size - taken - 1) / factorial(size)
            for known in combinations(others, taken):
                product = np.full(inside.shape[:-1], factor)
                for i in others:
                    product = product * (inside[..., i] if i in known else share[..., i])
                weight += product
        yield value * (inside[..., j] - share[..., j]) * weight


def shapley_values(tables, inputs, n_features, rows_per_step=1024):
    """Exact path-dependent Shapley values of a batch.

    A leaf contributes its value times, per path feature, either whether the row
    lies in the interval (feature known) or the training share (unknown). With at
    most depth features on a path, summing over their subsets is a short loop.
    """
    result = np.zeros((len(inputs), n_features))
    for start in range(0, len(inputs), rows_per_step):
        rows = inputs[start : start + rows_per_step]
        for size, table in tables.items():
            if size == 0:
                continue
            values = rows[:, table["feature"]]
            inside = np.where(np.isnan(values), table["null"], (values > table["low"]) & (values <= table["high"])).astype(float)
            for j, effect in enumerate(_effects(table["value"], inside, table["share"])):
                columns = np.eye(n_features)[table["feature"][:, j]]
                result[start : start + rows_per_step] += effect @ columns
    return result


def outcome_tables(trees, n_features):
    """The attributions that a tree adds, for every outcome of its splits: a row's outcomes are then all
    that has to be found out. Leaves are taken together as long as their paths meet at most
    ``TABLE_SPLITS`` splits: ``(splits, attributions by outcome)``, where bit k of an outcome is set
    if a row goes left at split k, and a split is its feature, its threshold and the side of nulls."""
    tables = []
    for tree in trees:
        groups = []
        for value, path in _paths(tree):
            nodes = {node for node, _ in path}
            if not groups or len(groups[-1][0] | nodes) > TABLE_SPLITS:
                groups.append((set(), []))
            groups[-1][0].update(nodes)
            groups[-1][1].append((value, path))
        for nodes, leaves in groups:
            order = sorted(nodes)
            left = np.arange(1 << len(order))[:, None] >> np.arange(len(order)) & 1 == 1
            table = np.zeros((len(left), n_features))
            for value, path in leaves:
                inside, share = {}, {}
                for node, goes_left in path:
                    feature, child = tree.feature[node], (tree.left if goes_left else tree.right)[node]
                    inside[feature] = inside.get(feature, True) & (left[:, order.index(node)] == goes_left)
                    share[feature] = share.get(feature, 1.0) * tree.cover[child] / tree.cover[node]
                if path:
                    known = np.stack([inside[f] for f in inside], axis=1).astype(float)
                    for feature, effect in zip(inside, _effects(value, known, np.array([share[f] for f in inside]))):
                        table[:, feature] += effect
            tables.append(([(tree.feature[n], tree.threshold[n], tree.null_left[n]) for n in order], table))
    return tables


def tabled_values(tables, inputs, n_features, rows_per_step=8192):
    """The values of ``shapley_values`` for a batch, looked up by the outcomes of each row's splits."""
    result = np.zeros((len(inputs), n_features))
    for start in range(0, len(inputs), rows_per_step):
        columns = np.ascontiguousarray(inputs[start : start + rows_per_step].T)
        null = np.isnan(columns)
        for splits, table in tables:
            outcome = np.zeros(columns.shape[1], dtype=np.intp)
            for bit, (feature, threshold, null_left) in enumerate(splits):
                left = columns[feature] <= threshold
                outcome += (left | null[feature] if null_left else left) * (1 << bit)
            result[start : start + rows_per_step] += table[outcome]
    return result


def attributions(df, model):
    """Log-odds attribution of every feature for every customer, as long rows.

    ``feature_value`` is the stored value, ``model_value`` the imputed one the model
    saw. Rows are explained in Arrow batches where they are; only tables bounded by
    the number of trees and their depth travel.
    """
    spark = df.sparkSession
    names = list(MODEL_FEATURES)
    tabled = outcome_tables([tree for tree in model.trees if tree.depth <= TABLE_SPLITS], len(names))
    deep = leaf_tables(model, [tree for tree in model.trees if tree.depth > TABLE_SPLITS])
    shared = spark.sparkContext.broadcast((tabled, deep, base_value(model, leaf_tables(model))))
    prepared = model.prepare(df.select("customer_id", *names)).select(
        "customer_id",
        *[F.col(c).cast("double").alias(c) for c in names],
        *[F.col(f"model_{c}").alias(f"model_{c}") for c in names],
    )

    def explain(batches):
        tabled, deep, base = shared.value
        for batch in batches:
            inputs = batch[[f"model_{c}" for c in names]].to_numpy(dtype=float)
            effects = tabled_values(tabled, inputs, len(names)) + shapley_values(deep, inputs, len(names))
            yield pd.DataFrame(
                {
                    "customer_id": np.repeat(batch["customer_id"].to_numpy(), len(names)),
                    "feature": np.tile(names, len(batch)),
                    "feature_value": batch[names].to_numpy(dtype=float).ravel(),
                    "model_value": inputs.ravel(),
                    "shap_value": effects.ravel(),
                    "base_value": base,
                }
            )

    schema = (
        "customer_id bigint, feature string, feature_value double, model_value double, shap_value double, base_value double"
    )
    explained = prepared.mapInPandas(explain, schema)
    # pandas has no null double; a missing value comes back as NaN.
    return explained.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("feature_value", "model_value")})


def linear_attributions(df, coefficients, means):
    """Attribution of a linear score: coefficient x (value - mean), as long rows."""
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            F.col(name).cast("double").alias("feature_value"),
            (F.lit(float(c)) * (F.col(name).cast("double") - F.lit(float(means[name])))).alias("shap_value"),
        )
        for name, c in coefficients.items()
    ]
    return df.select("customer_id", F.inline(F.array(*entries)))


def _per_customer_order(*order):
    # At most one row per feature and customer, so these groups stay tiny.
    return Window.partitionBy("customer_id").orderBy(*order, "feature")


def top_drivers(attr, k=3):
    """The ``k`` features that raise a customer's risk most."""
    rank = F.row_number().over(_per_customer_order(F.desc("shap_value")))
    return attr.where(F.col("shap_value") > 0).withColumn("position", rank).where(F.col("position") <= k)


def protective_factors(attr, k=3):
    """The ``k`` features that lower a customer's risk most."""
    rank = F.row_number().over(_per_customer_order(F.asc("shap_value")))
    return attr.where(F.col("shap_value") < 0).withColumn("position", rank).where(F.col("position") <= k)


def attribution_summary(attr, k=5):
    """The ``k`` largest effects of each customer in either direction, with a direction text."""
    rank = F.row_number().over(_per_customer_order(F.desc(F.abs("shap_value"))))
    impact = F.when(F.col("shap_value") > 0, "Increases churn risk").otherwise("Decreases churn risk")
    return attr.withColumns({"position": rank, "impact": impact}).where(F.col("position") <= k)


def mean_absolute_attribution(attr):
    """Mean size of each feature's effect over the population."""
    return (
        attr.groupBy("feature")
        .agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )


def _driver_lists(attr, k=3):
    """``top_drivers`` and ``protective_factors`` as a list a customer each, null if there are none. Both come
    from one grouping, at most one effect a feature, so that attributions are computed once."""
    effect = F.struct("feature", "feature_value", "shap_value")
    grouped = attr.groupBy("customer_id").agg(F.collect_list(effect).alias("effects"))

    def strongest(sign):
        wanted = F.filter("effects", lambda e: e["shap_value"] * sign > 0)
        ordered = F.array_sort(F.transform(wanted, lambda e: F.struct((e["shap_value"] * -sign).alias("order"), e["feature"], e["feature_value"], e["shap_value"])))
        first = F.transform(
            F.slice(ordered, 1, k),
            lambda e, i: F.struct(
                (i + 1).alias("position"), e["feature"].alias("feature"), e["feature_value"].alias("feature_value"), e["shap_value"].alias("shap_value")
            ),
        )
        return F.when(F.exists("effects", lambda e: e["shap_value"] * sign > 0), first)

    return grouped.select("customer_id", strongest(1).alias("churn_drivers"), strongest(-1).alias("protective_factors"))


def customer_360(ids, customers, churn_features, rfm, predictions, attr):
    """One row per requested customer: profile, behaviour, segment, prediction, its
    drivers (at most three each way) and the recommended action."""
    wanted = ids.select("customer_id").distinct()
    attr = attr.join(wanted, "customer_id", "left_semi")
    scores = rfm.select("customer_id", "r_score", "f_score", "m_score", "rfm_score", "customer_segment")
    forecast = recommendation(predictions.select("customer_id", "churn_probability", "prediction", "risk_level"))
    joined = wanted.join(customers, "customer_id", "left").join(churn_features, "customer_id", "left")
    for part in (scores, forecast, _driver_lists(attr)):
        joined = joined.join(part, "customer_id", "left")
    return joined


def prediction_roundtrip(df, first, second):
    """Rows scored by both models and the largest difference of probability and class."""
    left = predict(first, df).select("customer_id", F.col("churn_probability").alias("p1"), F.col("prediction").alias("c1"))
    right = predict(second, df).select("customer_id", F.col("churn_probability").alias("p2"), F.col("prediction").alias("c2"))
    return left.join(right, "customer_id").agg(
        F.count(F.lit(1)).alias("customers"),
        F.max(F.abs(F.col("p1") - F.col("p2"))).alias("max_probability_difference"),
        F.count_if(F.col("c1") != F.col("c2")).alias("class_differences"),
    )
