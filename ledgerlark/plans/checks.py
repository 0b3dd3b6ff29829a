"""What can be said of fitted models without their numbers: rows they saw, and agreements
between figures that are reached in different ways."""

from functools import reduce

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlark.operators import scoring, training
from ledgerlark.schemas import MODEL_FEATURES

_TOLERANCE = 1e-9


def _auc_elsewhere(judged):
    """The area under the curve by the library's evaluator instead of by counting pairs."""
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="churn_probability", labelCol="label", numBins=0)
    return evaluator.evaluate(judged.withColumn("label", F.col("churned").cast("double")))


def _mean_loss(probability):
    inside = F.greatest(F.least(probability, F.lit(1 - 1e-15)), F.lit(1e-15))
    return F.avg(F.when(F.col("churned") == 1, -F.log(inside)).otherwise(-F.log(1 - inside)))


def fitted_model(split, model):
    """One row: rows of each part and label, whether the model's loss over the rows fitted is
    below that of their share of churners, and whether the AUC of the other part holds."""
    judged = training.predict(model, split)
    train, test = judged.where(~F.col("is_test")), judged.where(F.col("is_test"))
    share = train.agg(F.avg("churned")).first()[0]
    loss, constant = train.agg(_mean_loss(F.col("churn_probability")), _mean_loss(F.lit(share))).first()
    auc = training.binary_metrics(test).first()["roc_auc"]
    counts = [
        F.count(F.when((F.col("is_test") == part) & (F.col("churned") == label), 1)).alias(f"{'test' if part else 'train'}_{name}")
        for part in (False, True)
        for label, name in ((1, "churned"), (0, "active"))
    ]
    return split.agg(*counts).select(
        "*", F.lit(loss < constant).alias("beats_share"), F.lit(abs(auc - _auc_elsewhere(test)) < _TOLERANCE).alias("auc_holds")
    )


def stationary(train, model):
    """Whether a penalised logistic fit has come to rest: no part of its loss's gradient is above 1e-4."""
    classifier = model.stages[-1]
    rows = model.transform(train).select(F.col("churned").cast("double").alias("y"), "probability", "features")
    off = vector_to_array("probability")[1] - F.col("y")
    values = vector_to_array("features")
    sums = rows.agg(F.avg(off).alias("bias"), *[F.avg(off * values[k]).alias(f"g{k}") for k in range(len(MODEL_FEATURES))]).first()
    pull = [sums[f"g{k}"] + classifier.getRegParam() * classifier.coefficients[k] for k in range(len(MODEL_FEATURES))]
    return max(map(abs, [sums["bias"], *pull])) < 1e-4


def logistic_model(split, model):
    rests = stationary(split.where(~F.col("is_test")), model)
    return fitted_model(split, model).withColumn("at_rest", F.lit(rests))


def tree_model(split, model, trees, depth):
    fitted = model.stages[-1]
    inside = fitted.getNumTrees == trees and all(tree.depth <= depth for tree in fitted.trees)
    return fitted_model(split, model).withColumn("size_holds", F.lit(inside))


def sweep(aucs, train, test):
    """Names, rows of both parts, and whether the two AUC lie between 0 and 1 with the stored gap."""
    bounded = F.col("train_auc").between(0, 1) & F.col("test_auc").between(0, 1)
    gap = F.abs(F.col("train_auc") - F.col("test_auc") - F.col("gap")) < _TOLERANCE
    sizes = [F.lit(part.count()).cast("bigint").alias(name) for name, part in (("train_rows", train), ("test_rows", test))]
    return aucs.select("model", *sizes, (bounded & gap).alias("bounded"))


def folds(per_fold, folded):
    """Held-out and fitted rows of each model and fold, and whether the figures are within bounds."""
    figures = ("test_auc", "test_f1", "test_precision", "test_recall", "train_auc")
    inside = reduce(lambda left, right: left & right, [F.col(name).between(0, 1) for name in figures])
    total = folded.count()
    rows = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("held_out_rows"))
    return per_fold.join(rows, "fold").select(
        "model", "fold", "held_out_rows", (F.lit(total) - F.col("held_out_rows")).cast("bigint").alias("train_rows"), inside.alias("bounded")
    )


def importance(weights):
    """Features, whether each weight is a share and all add up to 1."""
    total = weights.agg(F.sum("importance")).first()[0]
    return weights.select("feature", F.col("importance").between(0, 1).alias("is_share"), F.lit(abs(total - 1) < _TOLERANCE).alias("adds_up"))


def metrics_table(stored, split):
    """The stored population, and whether the stored ratios are those of whole test rows."""
    rows = split.where(F.col("is_test")).count()
    right = F.col("accuracy") * rows
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    whole = (F.abs(right - F.round(right)) < 1e-6) & (F.abs(f1 - F.col("f1_score")) < _TOLERANCE) & F.col("roc_auc").between(0, 1)
    return stored.select("model", "total_customers", "churned_customers", "active_customers", "churn_rate", F.lit(rows).cast("bigint").alias("test_rows"), whole.alias("whole"))


def scores(scored, modeling, model):
    """One row a customer: whether level, class and stored probability follow from the unrounded one."""
    plain = training.predict(model, modeling.select("customer_id", *MODEL_FEATURES)).select("customer_id", F.col("churn_probability").alias("p"))
    level = F.when(F.col("p") >= 0.75, "HIGH").when(F.col("p") >= 0.5, "MEDIUM").otherwise("LOW")
    return scored.join(plain, "customer_id").select(
        "customer_id",
        (F.col("risk_level") == level).alias("level_holds"),
        (F.col("prediction") == (F.col("p") > 0.5).cast("int")).alias("class_holds"),
        (F.abs(F.col("churn_probability").cast("double") - F.col("p")) <= 5.1e-7).alias("stored_holds"),
        "prediction_date",
    )


def attributions(rows, modeling, model):
    """Customer, feature, raw and imputed value, and whether a customer's attributions and the
    base add up to the log-odds of the predicted probability."""
    plain = training.predict(model, modeling.select("customer_id", *MODEL_FEATURES)).select(
        "customer_id", F.log(F.col("churn_probability") / (1 - F.col("churn_probability"))).alias("odds")
    )
    sums = rows.groupBy("customer_id").agg((F.sum("shap_value") + F.first("base_value")).alias("sum"))
    held = sums.join(plain, "customer_id").select("customer_id", (F.abs(F.col("sum") - F.col("odds")) < 1e-6).alias("adds_up"))
    return rows.select("customer_id", "feature", "feature_value", "model_value").join(held, "customer_id")


def scoring_job(t, scored_at, store, root):
    """Score all modelling customers, save them by upsert, and read the stored table."""
    store.upsert_predictions(t.spark, root, scoring.score_customers(t.modeling, t.final, scored_at))
    return store.read_current(t.spark, root)
