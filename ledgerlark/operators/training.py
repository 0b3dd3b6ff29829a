"""Splitting, preparing, fitting and judging churn models.

Preparation is exact: medians and scaling figures are computed on the training
rows and written into the saved pipeline as an expression, so that scoring later
applies precisely the same numbers.
"""

from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions import ranking
from ledgerlark.functions.exact import count_if, ratio
from ledgerlark.operators import boosting, forest
from ledgerlark.operators.sales import churn_population
from ledgerlark.plans.lineage import cut
from ledgerlark.schemas import MODEL_FEATURES

# Fixed values of the study: seed, skewed features, and model settings.
SEED = 42
LOG_FEATURES = [
    "frequency",
    "monetary_value",
    "average_order_value",
    "unique_products",
    "total_quantity",
    "average_order_gap",
]
BOOSTED = {"trees": 300, "depth": 4, "rate": 0.05, "min_child": 1}
FINAL = {"trees": 200, "depth": 3, "rate": 0.03, "min_child": 5}
SWEEP = {
    "boosted_1": {"trees": 150, "depth": 2, "rate": 0.05, "min_child": 5},
    "boosted_2": {"trees": 200, "depth": 2, "rate": 0.03, "min_child": 5},
    "boosted_3": {"trees": 200, "depth": 3, "rate": 0.03, "min_child": 5},
    "boosted_4": {"trees": 150, "depth": 3, "rate": 0.05, "min_child": 10},
}
FOREST_TREES, FOREST_DEPTH = 300, 30
# Rows that one task of a forest's fit cuts into bins and deals to the trees.
FOREST_TASK_ROWS = 1 << 13


# ---- splitting -----------------------------------------------------------------


def stratified_split(df, label="churned", key="customer_id", test=0.2, seed=SEED):
    """Add ``is_test``: per label, the first ``ceil(test * n)`` rows in hash order."""
    ranked = ranking.add_hash_rank(df, label, key, seed)
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(Decimal(str(test)))
    limits = counts.select("_label", F.ceil(F.col("_n").cast("decimal(20,0)") * share).alias("_limit"))
    return (
        ranked.join(limits, F.col(label).eqNullSafe(F.col("_label")))
        .withColumn("is_test", F.col("hash_rank") <= F.col("_limit"))
        .drop("hash_rank", "_label", "_limit")
    )


def split_summary(split, label="churned"):
    """Rows of each part and label, and the label's share of the part."""
    counts = split.groupBy("is_test", label).agg(F.count(F.lit(1)).alias("rows"))
    part = Window.partitionBy("is_test")
    return counts.withColumn("share", ratio("rows", F.sum("rows").over(part)))


def stratified_kfold(df, k=5, label="churned", key="customer_id", seed=SEED):
    """Add ``fold`` 0..k-1, dealt in hash order within each label."""
    ranked = ranking.add_hash_rank(df, label, key, seed)
    return ranked.withColumn("fold", ((F.col("hash_rank") - 1) % k).cast("int")).drop("hash_rank")


# ---- preparation ---------------------------------------------------------------


def feature_medians(train, columns=MODEL_FEATURES):
    """Exact median of each feature over the (stored) training rows; all null counts as 0."""
    middle = ranking.quantiles(train, columns, [0.5])
    return {name: 0.0 if values[0] is None else values[0] for name, values in middle.items()}


def impute_median(df, medians):
    """Features as doubles, nulls replaced by the training median."""
    return df.withColumns({name: F.coalesce(F.col(name).cast("double"), F.lit(m)) for name, m in medians.items()})


def scaling_stats(df, columns=MODEL_FEATURES):
    """``{column: (mean, population deviation)}``; a constant column scales by 1."""
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"std_{c}") for c in columns],
    ).first()
    return {c: (row[f"mean_{c}"], row[f"std_{c}"] or 1.0) for c in columns}


def standard_scale(df, stats):
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def log1p_features(df, columns=LOG_FEATURES):
    """log(1 + x) of the skewed features."""
    return df.withColumns({c: F.log1p(F.col(c).cast("double")) for c in columns})


# ---- fitting -------------------------------------------------------------------


def _prepared(name):
    return f"model_{name}"


def _sql(expressions):
    """A saved pipeline stage that adds the prepared features as ``model_*`` columns."""
    added = ", ".join(f"{text} AS {_prepared(name)}" for name, text in expressions.items())
    return SQLTransformer(statement=f"SELECT *, {added} FROM __THIS__")


def _imputed(medians):
    return {name: f"coalesce(CAST({name} AS DOUBLE), {m!r}D)" for name, m in medians.items()}


def _scaled(expressions, train, medians, logged=()):
    stats = scaling_stats(log1p_features(impute_median(train, medians), logged) if logged else impute_median(train, medians))
    return {name: f"(({text}) - ({stats[name][0]!r}D)) / {stats[name][1]!r}D" for name, text in expressions.items()}


def _fit(train, expressions, classifier):
    assembler = VectorAssembler(inputCols=[_prepared(c) for c in MODEL_FEATURES], outputCol="features")
    labelled = train.withColumn("label", F.col("churned").cast("double"))
    return Pipeline(stages=[_sql(expressions), assembler, classifier]).fit(labelled)


def train_logistic(train, logged=(), max_iter=1000):
    """L2 logistic regression with unit inverse strength on scaled features."""
    medians = feature_medians(train)
    expressions = _imputed(medians)
    expressions = {c: f"log1p({e})" if c in logged else e for c, e in expressions.items()}
    classifier = LogisticRegression(
        regParam=1.0 / train.count(), elasticNetParam=0.0, maxIter=max_iter, standardization=False
    )
    return _fit(train, _scaled(expressions, train, medians, logged), classifier)


def train_logistic_log(train, max_iter=1000):
    return train_logistic(train, LOG_FEATURES, max_iter)


def train_random_forest(train, trees=FOREST_TREES, depth=FOREST_DEPTH, seed=SEED, min_rows_per_leaf=1):
    """Bagged trees, fitted on all labelled rows (see ``operators/forest.py``). Each row's node is kept
    from level to level instead of walking down from the root."""
    classifier = forest.ForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, minInstancesPerNode=min_rows_per_leaf,
        maxBins=forest.BINS, cacheNodeIds=True,
    )
    tasks = max(1, -(-train.count() // FOREST_TASK_ROWS))
    return _fit(train.repartition(tasks, "customer_id"), _imputed(feature_medians(train)), classifier)


def train_boosted(train, config=BOOSTED, seed=SEED, impute=True):
    """Boosted trees with row and column sampling of 0.8 a tree. Nulls are the training median as in
    the study, or without ``impute`` a value of their own that learns its side."""
    return boost_all({"train": train}, {"model": config}, seed, impute)["train", "model"]


def boost_all(parts, configs, seed=SEED, impute=True):
    """``{(part, config): model}`` for every table of training rows and every setting, in one series of
    jobs. Settings that differ in the number of trees only share one fit."""
    texts = {}
    for name, rows in parts.items():
        texts[name] = _imputed(feature_medians(rows)) if impute else {c: f"CAST({c} AS DOUBLE)" for c in MODEL_FEATURES}
    longest = {}
    for name, config in configs.items():
        shape = tuple(sorted((k, v) for k, v in config.items() if k != "trees"))
        if shape not in longest or configs[longest[shape]]["trees"] < config["trees"]:
            longest[shape] = name
    prepared = {
        name: rows.select("customer_id", "churned", *[F.expr(text).alias(c) for c, text in texts[name].items()])
        for name, rows in parts.items()
    }
    fitted = boosting.fit_boosted(prepared, {name: configs[name] for name in longest.values()}, MODEL_FEATURES, seed=seed)
    models = {}
    for part in parts:
        for name, config in configs.items():
            shape = tuple(sorted((k, v) for k, v in config.items() if k != "trees"))
            base, trees = fitted[part, longest[shape]]
            models[part, name] = boosting.BoostedModel(texts[part], base, trees[: config["trees"]])
    return models


def train_final(train):
    return train_boosted(train, FINAL)


def predict(model, df):
    """Probability of class 1 as ``churn_probability`` and the class as ``prediction``."""
    scored = model.transform(df)
    keep = [c for c in df.columns if c not in ("churn_probability", "prediction")]
    return scored.select(
        *keep,
        (F.col("probability") if isinstance(model, boosting.BoostedModel) else vector_to_array("probability"))[1].alias("churn_probability"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def save_model(spark, model, path):
    """A boosted model as one line of text below ``path``, any other as a pipeline."""
    if isinstance(model, boosting.BoostedModel):
        spark.createDataFrame([(model.text(),)], "value string").write.mode("overwrite").text(f"{path}/boosted")
    else:
        model.write().overwrite().save(path)


def load_model(spark, path):
    """The saved model; a missing one is an error of its own kind."""
    try:
        return boosting.BoostedModel.of_text(spark.read.text(f"{path}/boosted").first()[0])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    try:
        return PipelineModel.load(path)
    except Exception as error:
        if "does not exist" in str(error) or "Input path" in str(error):
            raise FileNotFoundError(f"model not found: {path}") from error
        raise


# ---- judging -------------------------------------------------------------------


def _cells(label, prediction):
    y, p = F.col(label), F.col(prediction)
    return {"tn": (y == 0) & (p == 0), "fp": (y == 0) & (p == 1), "fn": (y == 1) & (p == 0), "tp": (y == 1) & (p == 1)}


def _or_zero(column):
    return F.coalesce(column, F.lit(0.0))


def binary_metrics(pred, *keys, label="churned", prediction="prediction", score="churn_probability"):
    """Accuracy, precision, recall, F1 of class 1 and exact ROC-AUC, per group of ``keys``.

    The AUC is a count of correctly ordered pairs, ties as halves. Rows are first
    reduced to one per distinct score and cut into ranges of about equal size; running
    totals are taken over the ranges and then inside each, never over all rows in one
    sorted run.
    """
    keys = list(keys)
    cells = _cells(label, prediction)
    scores = ranking.in_ranges(
        pred.groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(
            count_if(F.col(label) == 1).alias("pos"),
            count_if(F.col(label) == 0).alias("neg"),
            *[count_if(condition).alias(name) for name, condition in cells.items()],
        ),
        *keys,
        "score",
    )
    below = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        scores.groupBy(*keys, "range")
        .agg(F.sum("neg").alias("range_neg"))
        .withColumn("neg_below", F.coalesce(F.sum("range_neg").over(below), F.lit(0)))
        .drop("range_neg")
    )
    inside = Window.partitionBy(*keys, "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ordered = scores.withColumn("neg_inside", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(
        ranges, [*keys, "range"]
    )
    half_pairs = F.col("pos").cast("decimal(19,0)") * (
        (F.col("neg_below") + F.col("neg_inside")) * 2 + F.col("neg")
    ).cast("decimal(19,0)")
    sums = ordered.groupBy(*keys).agg(
        F.sum(half_pairs).alias("half_pairs"), *[F.sum(c).alias(c) for c in ("pos", "neg", "tn", "fp", "fn", "tp")]
    )
    precision, recall = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    f1 = ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn"))
    pairs = F.col("pos").cast("double") * F.col("neg").cast("double")
    return sums.select(
        *keys,
        ratio(F.col("tp") + F.col("tn"), F.col("pos") + F.col("neg")).alias("accuracy"),
        _or_zero(precision).alias("precision"),
        _or_zero(recall).alias("recall"),
        _or_zero(f1).alias("f1_score"),
        F.try_divide(F.col("half_pairs").cast("double") / 2, pairs).alias("roc_auc"),
    )


def confusion_matrix(pred, label="churned", prediction="prediction"):
    """Actual class against predicted class, zero-filled."""
    counts = pred.agg(*[count_if(condition).alias(name) for name, condition in _cells(label, prediction).items()])
    rows = [
        F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_0"), F.col("fp").alias("predicted_1")),
        F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_0"), F.col("tp").alias("predicted_1")),
    ]
    return counts.select(F.inline(F.array(*rows)))


def classification_report(pred, label="churned", prediction="prediction"):
    """Precision, recall, F1 and support per class, with accuracy and the two means."""
    counts = pred.agg(*[count_if(condition).alias(name) for name, condition in _cells(label, prediction).items()])

    def scores(hit, wrongly, missed):
        hit, wrongly, missed = F.col(hit), F.col(wrongly), F.col(missed)
        return {
            "precision": _or_zero(ratio(hit, hit + wrongly)),
            "recall": _or_zero(ratio(hit, hit + missed)),
            "f1_score": _or_zero(ratio(hit * 2, hit * 2 + wrongly + missed)),
            "support": hit + missed,
        }

    zero, one = scores("tn", "fn", "fp"), scores("tp", "fp", "fn")
    total = zero["support"] + one["support"]
    accuracy = ratio(F.col("tn") + F.col("tp"), total)

    def row(name, values):
        return F.struct(F.lit(name).alias("class"), *[values[c].alias(c) for c in ("precision", "recall", "f1_score", "support")])

    names = ("precision", "recall", "f1_score")
    macro = {c: (zero[c] + one[c]) / 2 for c in names}
    weighted = {c: ratio(zero[c] * zero["support"] + one[c] * one["support"], total) for c in names}
    rows = [
        row("0", zero),
        row("1", one),
        row("accuracy", {**dict.fromkeys(names, accuracy), "support": total}),
        row("macro avg", {**macro, "support": total}),
        row("weighted avg", {**weighted, "support": total}),
    ]
    return counts.select(F.inline(F.array(*rows)))


def _together(predictions):
    result = predictions[0]
    for part in predictions[1:]:
        result = result.unionByName(part)
    return result


def train_test_auc(models, train, test):
    """AUC on both parts for each ``{name: model}``, best on the test part first."""
    parts = [
        predict(model, part.select("customer_id", *MODEL_FEATURES, "churned"))
        .select("churned", "prediction", "churn_probability")
        .withColumns({"model": F.lit(name), "part": F.lit(where)})
        for name, model in models.items()
        for where, part in (("train", train), ("test", test))
    ]
    judged = binary_metrics(_together(parts), "model", "part")
    side = {where: F.max(F.when(F.col("part") == where, F.col("roc_auc"))) for where in ("train", "test")}
    return (
        judged.groupBy("model")
        .agg(side["train"].alias("train_auc"), side["test"].alias("test_auc"))
        .withColumn("gap", F.col("train_auc") - F.col("test_auc"))
        .orderBy(F.desc("test_auc"), "model")
    )


def fit_all(fits, parallelism=8):
    """Run independent fits, ``{name: function}``, side by side; each is a series of
    short distributed jobs that leaves most of a cluster idle on its own."""
    with ThreadPoolExecutor(parallelism) as pool:
        futures = {name: pool.submit(fit) for name, fit in fits.items()}
        return {name: future.result() for name, future in futures.items()}


def config_sweep(train, test, configs=None, models=None):
    """Train and test AUC of each boosted configuration, best first. Already fitted
    ``models`` are used as they are."""
    models = dict(models or {})
    configs = configs or SWEEP
    missing = {name: config for name, config in configs.items() if name not in models}
    if missing:
        models.update({name: model for (_, name), model in boost_all({"train": train}, missing).items()})
    return train_test_auc({name: models[name] for name in configs}, train, test)


def cross_validate(fits, folded, k=5, parallelism=8):
    """Per model and fold: metrics on the held-out fold, and AUC on the rows fitted.

    ``fits`` maps a name to a function of the training rows; ``folded`` carries ``fold``.
    """
    folded = cut(folded.select("customer_id", *MODEL_FEATURES, "churned", "fold"), "folds")
    jobs = {
        (name, fold): (lambda f=fit, i=fold: f(folded.where(F.col("fold") != i)))
        for name, fit in fits.items()
        for fold in range(k)
    }
    return _judged_folds(fit_all(jobs, parallelism), folded)


def _judged_folds(models, folded):
    """The same for fitted ``{(name, fold): model}``."""
    scored = [
        predict(model, folded).select(
            "churned", "prediction", "churn_probability", (F.col("fold") == fold).alias("held_out"),
            F.lit(name).alias("model"), F.lit(fold).alias("cv_fold"),
        )
        for (name, fold), model in models.items()
    ]
    judged = binary_metrics(_together(scored), "model", "cv_fold", "held_out")
    held = F.col("held_out")
    columns = {"test_auc": "roc_auc", "test_f1": "f1_score", "test_precision": "precision", "test_recall": "recall"}
    return judged.groupBy("model", F.col("cv_fold").alias("fold")).agg(
        *[F.max(F.when(held, F.col(column))).alias(name) for name, column in columns.items()],
        F.max(F.when(~held, F.col("roc_auc"))).alias("train_auc"),
    )


def cv_summary(per_fold):
    """Means over folds and the population deviation of AUC, best mean first."""
    return (
        per_fold.groupBy("model")
        .agg(
            F.avg("test_auc").alias("cv_auc_mean"),
            F.stddev_pop("test_auc").alias("cv_auc_std"),
            F.avg("test_f1").alias("cv_f1_mean"),
            F.avg("test_precision").alias("cv_precision_mean"),
            F.avg("test_recall").alias("cv_recall_mean"),
            F.avg("train_auc").alias("train_auc_mean"),
        )
        .orderBy(F.desc("cv_auc_mean"), "model")
    )


def cv_folds(folded, k=5, configs=None):
    """Metrics of each configuration and fold; all fits grow together."""
    folded = cut(folded.select("customer_id", *MODEL_FEATURES, "churned", "fold"), "folds")
    models = boost_all({fold: folded.where(F.col("fold") != fold) for fold in range(k)}, configs or SWEEP)
    return _judged_folds({(name, fold): model for (fold, name), model in models.items()}, folded)


def cv_config_sweep(folded, k=5, configs=None):
    return cv_summary(cv_folds(folded, k, configs))


def staged_auc(model, df, after):
    """AUC of a boosted model after each of these numbers of trees, from one scoring pass."""
    rows = model.staged(df.select("churned", *MODEL_FEATURES), after).select("churned", "trees", "churn_probability")
    judged = rows.withColumn("prediction", F.when(F.col("churn_probability") > 0.5, 1).otherwise(0))
    return binary_metrics(judged, "trees").select("trees", "roc_auc")


def feature_importance(spark, model):
    """Gain importance of each feature in a fitted tree model; sums to 1."""
    booster = model.stages[-1]
    weights = booster.importances() if isinstance(booster, boosting.BoostedModel) else booster.featureImportances
    rows = [(name, float(weights[i])) for i, name in enumerate(MODEL_FEATURES)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def model_metrics_table(metrics, modeling, name="boosted trees"):
    """One row of stored model quality next to the population it speaks about."""
    population = churn_population(modeling).select(F.struct("*").alias("p")).scalar()
    return metrics.withColumn("population", population).select(
        F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1_score", "roc_auc", "population.*"
    )
