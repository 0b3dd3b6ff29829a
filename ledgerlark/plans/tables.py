"""Derived tables shared by the registered queries.

The chain stores each table once per session and input folder, and reports read
the stored tables, so that lines are joined and deduplicated once and not by every
report. Queries that are about building such a table build it anew.
"""

from functools import cached_property

from pyspark.sql import functions as F

from ledgerlark.functions.exact import mean
from ledgerlark.operators import audit, churn, cleaning, features, rfm, sales, scoring, training
from ledgerlark.plans import checks
from ledgerlark.plans.lineage import cut, observed, scratch_path, side_session
from ledgerlark.schemas import MODEL_FEATURES
from ledgerlark.sources import tables as store
from ledgerlark.sources import testdata

# Weights of the linear stand-in score, so that explanations can be checked in SQL.
LINEAR_WEIGHTS = {
    "recency_days": 0.01,
    "frequency": -0.05,
    "monetary_value": -0.00001,
    "average_order_value": 0.00002,
    "unique_products": -0.02,
    "total_quantity": 0.0005,
    "average_order_gap": 0.03,
    "customer_tenure_days": -0.001,
}

_per_session = {}


def tables(spark, sf_dir):
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _per_session:
        _per_session[key] = Tables(spark, str(sf_dir))
    return _per_session[key]


class Tables:
    cutoff = testdata.CUTOFF
    end = testdata.END

    def __init__(self, spark, sf_dir):
        self.spark = spark
        self.sf_dir = sf_dir

    # ---- lines ----

    @cached_property
    def written_raw(self):
        """Raw lines as stored, what was counted while they were written, and their path."""
        path = scratch_path(self.spark, "raw-lines")
        lines = testdata.raw_lines(side_session(self.spark), self.sf_dir)
        measures = audit.missing_measures(lines.columns) | audit.invalid_value_measures()
        lines, counts = observed(self.spark, lines, measures, "raw-lines")
        lines.write.parquet(path)
        return self.spark.read.schema(lines.schema).parquet(path), counts, path

    @property
    def raw(self):
        return self.written_raw[0]

    @property
    def raw_aside(self):
        """The stored raw lines in a session of their own."""
        return side_session(self.spark).read.schema(self.raw.schema).parquet(self.written_raw[2])

    @cached_property
    def written_clean(self):
        """Clean lines as stored, with the month that they are partitioned by, the violations of
        their sales counted while they were written, and their path."""
        path = scratch_path(self.spark, "clean-lines")
        lines = cleaning.clean(self.raw_aside)
        lines, counts = observed(self.spark, lines, cleaning.quality_measures(lines.columns, cleaning.is_sale()), "clean-lines")
        store.write_lines(lines, path, dealt=True)
        return store.read_lines(self.spark, path), counts, path

    @property
    def monthly_clean(self):
        return self.written_clean[0]

    @property
    def clean(self):
        return self.monthly_clean.drop(store.MONTH)

    @property
    def clean_aside(self):
        """The stored clean lines, with their month, in a session of their own: for tables that group every line."""
        return store.read_lines(side_session(self.spark), self.written_clean[2])

    @property
    def sales(self):
        return cleaning.sales_lines(self.clean)

    @property
    def customer_lines(self):
        return cleaning.customer_lines(self.sales)

    @property
    def monthly_customer_lines(self):
        """The same with the stored month, for reports that need some months only."""
        return cleaning.customer_lines(cleaning.sales_lines(self.monthly_clean))

    @cached_property
    def report_totals(self):
        path = scratch_path(self.spark, "report-totals")
        totals = sales.report_totals(self.sales)
        totals.write.partitionBy("kind").parquet(path)
        return self.spark.read.schema(totals.schema).parquet(path)

    @cached_property
    def count_sketches(self):
        return cut(sales.count_sketches(self.orders), "count-sketches")

    @property
    def orders(self):
        return sales.order_table(self.report_totals)

    @property
    def sold_products(self):
        return sales.product_table(self.report_totals)

    # ---- customers and products ----

    @cached_property
    def features(self):
        return cut(self.build_features(), "features", self.spark)

    def build_features(self):
        return features.customer_features(cleaning.sales_lines(self.clean_aside))

    @cached_property
    def features_with_returns(self):
        return cut(self.build_features_with_returns(), "features-returns", self.spark)

    def build_features_with_returns(self):
        return features.customer_features(self.clean_aside)

    @cached_property
    def rfm(self):
        return cut(rfm.customer_rfm(self.features), "rfm")

    @cached_property
    def rfm_with_returns(self):
        return cut(rfm.customer_rfm(self.features_with_returns), "rfm-returns")

    @cached_property
    def customers(self):
        return cut(features.customers_dim(cleaning.customer_lines(cleaning.sales_lines(self.clean_aside))), "customers", self.spark)

    @property
    def scored_customers(self):
        """The customer dimension of the stored features, which the RFM scores need anyway."""
        return features.customers_of_features(self.features)

    @cached_property
    def products(self):
        return cut(features.products_dim(self.sales), "products")

    # ---- churn ----

    @cached_property
    def labels(self):
        return cut(self.build_labels(), "labels")

    def build_labels(self):
        return churn.churn_labels(self.customer_lines, self.cutoff, self.end)

    @cached_property
    def churn_features(self):
        return cut(self.build_churn_features(), "churn-features", self.spark)

    def build_churn_features(self):
        return churn.churn_features(cleaning.customer_lines(cleaning.sales_lines(self.clean_aside)), self.cutoff)

    @cached_property
    def modeling(self):
        return cut(churn.churn_modeling(self.churn_features, self.labels), "modeling")

    @cached_property
    def predictions(self):
        return cut(testdata.pseudo_predictions(self.customer_lines, self.cutoff), "predictions")

    @property
    def buyers_after_cutoff(self):
        """Ids for lookups by customer: those active in the label window."""
        lines = self.customer_lines
        return lines.where(lines.invoice_date > testdata.timestamp(self.cutoff)).select("customer_id").distinct()

    @property
    def fresh_predictions(self):
        """A later scoring of the customers active in the label window, some of them new."""
        score = (F.col("customer_id") * 104729) % 1000
        return self.buyers_after_cutoff.select(
            "customer_id",
            (score / F.lit(1000.0)).cast("decimal(8,6)").alias("churn_probability"),
            F.when(score > 500, 1).otherwise(0).cast("tinyint").alias("prediction"),
            F.when(score >= 750, "HIGH").when(score >= 500, "MEDIUM").otherwise("LOW").alias("risk_level"),
            testdata.timestamp("2001-08-02 00:00:00").alias("prediction_date"),
        )

    @property
    def judged(self):
        """Stand-in predictions next to the observed label."""
        return self.predictions.join(self.labels.select("customer_id", "churned"), "customer_id")

    @cached_property
    def split(self):
        return cut(training.stratified_split(self.modeling), "split")

    @property
    def train(self):
        return self.split.where(~F.col("is_test")).drop("is_test")

    @property
    def test(self):
        return self.split.where(F.col("is_test")).drop("is_test")

    @cached_property
    def logistic(self):
        return training.train_logistic(self.train)

    @cached_property
    def logistic_log(self):
        return training.train_logistic_log(self.train)

    @cached_property
    def forest(self):
        return training.train_random_forest(self.train)

    @cached_property
    def boosted(self):
        return training.train_boosted(self.train)

    @cached_property
    def final(self):
        return training.train_final(self.train)

    @cached_property
    def folded(self):
        return cut(training.stratified_kfold(self.train), "folded")

    @cached_property
    def model_aucs(self):
        models = {"logistic": self.logistic, "logistic_log": self.logistic_log, "final": self.final}
        return cut(training.train_test_auc(models, self.train, self.test), "aucs")

    @cached_property
    def sweep_aucs(self):
        return cut(training.config_sweep(self.train, self.test, models={"boosted_3": self.final}), "sweep")

    @cached_property
    def logistic_folds(self):
        return cut(training.cross_validate({"logistic": training.train_logistic}, self.folded), "logistic-folds")

    @cached_property
    def boosted_folds(self):
        return cut(training.cv_folds(self.folded), "boosted-folds")

    @cached_property
    def model_metrics(self):
        """The quality of the final model as training stores it; reports read it."""
        measured = training.binary_metrics(training.predict(self.final, self.test))
        return cut(training.model_metrics_table(measured, self.modeling), "model-metrics")

    @cached_property
    def model_predictions(self):
        """Predictions of the final model, scored, saved and read by one job."""
        return checks.scoring_job(self, testdata.SCORED_AT, store, scratch_path(self.spark, "model-predictions"))

    @property
    def linear_attributions(self):
        modeling = self.modeling
        means = modeling.agg(*[mean(c).alias(c) for c in MODEL_FEATURES]).first().asDict()
        # An unknown gap counts as the mean one and so has no effect.
        gap = F.coalesce(F.col("average_order_gap").cast("double"), F.lit(means["average_order_gap"]))
        return scoring.linear_attributions(modeling.withColumn("average_order_gap", gap), LINEAR_WEIGHTS, means)
