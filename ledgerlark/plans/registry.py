"""Every registered query: name -> function of (session, input folder)."""

from functools import reduce

from pyspark.sql import functions as F

from ledgerlark.functions.exact import ratio
from ledgerlark.operators import (
    audit,
    boosting,
    churn,
    cleaning,
    dashboard,
    features,
    lookup,
    predictions,
    report,
    rfm,
    sales,
    scoring,
    training,
)
from ledgerlark.plans.lineage import scratch_path
from ledgerlark.plans import checks
from ledgerlark.plans.tables import tables
from ledgerlark.schemas import CUSTOMER_FEATURES, MODEL_FEATURES, PREDICTIONS, RAW_LINES, TRANSACTIONS
from ledgerlark.sources import tables as store
from ledgerlark.sources import testdata

_RAW_ORDER = ["invoicedate", "invoice", "stockcode", "quantity", "price", "description", "customer_id", "country"]
_DESCRIBED = ["quantity", "price", "invoice", "stockcode", "description", "country"]


def _rounded(df, column, digits):
    """Order-dependent floating sums differ in the last bits between runs."""
    return df.withColumn(column, F.round(column, digits))


def _without_keys(raw):
    """Raw lines with gaps: no invoice where 13 pieces were sold, no stock code where 17 were."""
    return raw.withColumns(
        {
            "invoice": F.when(F.col("quantity") != 13, F.col("invoice")),
            "stockcode": F.when(F.col("quantity") != 17, F.col("stockcode")),
        }
    )


def _reject_counts(lines):
    return cleaning.rejected_lines(lines).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("lines"))


def _distinct_profiles(t):
    parts = [audit.distinct_profile(t.raw, c) for c in ("customer_id", "country", "stockcode")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


AUDIT = {
    "table_shape": lambda t: audit.table_shape(t.raw),
    "table_samples": lambda t: audit.table_samples(t.raw, _RAW_ORDER),
    "missing_summary": lambda t: audit.missing_summary(t.raw),
    "describe_all": lambda t: _rounded(
        audit.describe_all(t.raw, _DESCRIBED), "std_value", 4
    ),
    "duplicate_count": lambda t: audit.duplicate_count(t.raw),
    "duplicate_rows": lambda t: audit.duplicate_rows(t.raw),
    "distinct_profile": _distinct_profiles,
    "distinct_values": lambda t: audit.distinct_values(t.modeling, "churned"),
    "missing_summary_observed": lambda t: audit.missing_table(t.written_raw[1](), t.raw.columns),
    "invalid_value_counts_observed": lambda t: t.written_raw[1]().select(*audit.invalid_value_measures()),
    "date_range": lambda t: audit.date_range(t.sales, "invoice_date"),
    "invalid_value_counts": lambda t: audit.invalid_value_counts(t.raw),
    "invalid_value_rows": lambda t: audit.invalid_value_rows(t.raw, _RAW_ORDER),
    "value_counts": lambda t: audit.value_counts(t.raw, "country", 20, normalize=True),
    "cancellation_audit": lambda t: audit.cancellation_audit(t.raw),
    "crosstab_cancel_return": lambda t: audit.crosstab_cancel_return(t.raw),
    "revenue_profile": lambda t: _rounded(audit.revenue_profile(t.raw), "std_value", 4),
    "row_and_customer_counts": lambda t: audit.row_and_customer_counts(t.sales),
}

CLEANING = {
    "normalize_columns": lambda t: cleaning.normalize_columns(
        t.raw.toDF(" Invoice", "StockCode", "Description ", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country")
    ),
    "standardize_types": lambda t: cleaning.standardize_types(t.raw),
    "drop_duplicate_lines": lambda t: cleaning.drop_duplicate_lines(cleaning.standardize_types(t.raw)),
    "fill_description": lambda t: cleaning.fill_description(cleaning.standardize_types(t.raw)),
    "flag_lines": lambda t: cleaning.clean(t.raw),
    "positive_price_lines": lambda t: cleaning.positive_price_lines(t.clean),
    "sales_lines": lambda t: cleaning.sales_lines(t.clean),
    "customer_lines": lambda t: cleaning.customer_lines(t.sales),
    "cleaning_report": lambda t: cleaning.cleaning_report(t.customer_lines),
    "cleaning_report_faulty": lambda t: cleaning.cleaning_report(cleaning.typed_lines(_without_keys(t.raw))),
    "rejected_line_counts": lambda t: _reject_counts(cleaning.typed_lines(_without_keys(t.raw))),
    "quality_checks": lambda t: cleaning.quality_checks(t.sales),
    "quality_checks_observed": lambda t: cleaning.quality_table(t.written_clean[1]()),
}


def _mixed_case(t):
    """Sales lines whose texts come in capitals where an even number of pieces was sold."""
    capital = F.col("quantity") % 2 == 0
    return t.sales.withColumns({c: F.when(capital, F.upper(c)).otherwise(F.col(c)) for c in ("country", "description")})


def _counts_by_quarter(t):
    """Exact counts of every quarter, which is stored nowhere, and whether merged sketches come within 3 %."""
    quarter = F.date_trunc("quarter", "month").cast("date")
    exact = sales.exact_counts(t.orders.withColumn("quarter", quarter), "quarter")
    near = sales.estimated_counts(t.count_sketches.withColumn("quarter", quarter), "quarter").withColumnsRenamed({"customers": "c", "orders": "o"})
    close = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 0.03 * F.col(y)
    return exact.join(near, "quarter").select(
        "quarter", "customers", "orders", close("c", "customers").alias("customers_close"), close("o", "orders").alias("orders_close")
    )

def _few_ids(t):
    """Ten customers to look up: the first of those active in the label window."""
    return [row.customer_id for row in t.buyers_after_cutoff.orderBy("customer_id").limit(10).collect()]


SALES = {
    "executive_kpis": lambda t: sales.executive_kpis(t.orders, t.modeling),
    "monthly_revenue": lambda t: sales.monthly_revenue(t.orders),
    "monthly_revenue_detail": lambda t: sales.monthly_revenue_detail(t.orders),
    "year_month_revenue": lambda t: sales.year_month_revenue(t.orders),
    "country_summary": lambda t: sales.country_summary(t.orders),
    "country_revenue": lambda t: sales.country_revenue(t.orders),
    "customer_countries": lambda t: sales.customer_countries(t.customers),
    "top_customers": lambda t: sales.top_customers(t.sales),
    "product_revenue": lambda t: sales.product_revenue(t.sold_products),
    "product_quantity": lambda t: sales.product_quantity(t.sold_products),
    "returns_summary": lambda t: sales.returns_summary(t.clean),
    "returns_summary_identified": lambda t: sales.returns_summary(t.clean, identified_only=True),
    "distinct_counts_by_quarter": _counts_by_quarter,
    "estimated_counts_by_country": lambda t: sales.estimated_counts(t.count_sketches, "country"),
    "country_totals_any_case": lambda t: sales.totals_any_case(_mixed_case(t), "country"),
    "product_totals_any_case": lambda t: sales.totals_any_case(_mixed_case(t), "stock_code", "description"),
    "product_units_any_case": lambda t: sales.matched_any_case(_mixed_case(t), t.sold_products),
    "customer_purchases_sql": lambda t: lookup.purchases(t.spark, t.sales, _few_ids(t), 5),
    "customer_trend_sql": lambda t: lookup.trend(t.spark, t.sales, _few_ids(t)),
    "customer_profile_sql": lambda t: lookup.profile(t.spark, _few_ids(t), t.customers, t.rfm, t.predictions, 0.25),
    "purchase_history": lambda t: sales.purchase_history(t.sales, t.modeling),
    "customer_purchase_trend": lambda t: sales.customer_purchase_trend(t.sales, t.modeling),
}

FEATURES = {
    "analysis_date": lambda t: features.analysis_date(t.sales),
    "customer_metrics": lambda t: features.customer_metrics(t.sales),
    "order_dates": lambda t: features.order_dates(t.customer_lines),
    "average_order_gap": lambda t: features.average_order_gap(t.customer_lines),
    "return_metrics": lambda t: features.return_metrics(t.clean),
    "customer_features": lambda t: t.build_features(),
    "customer_features_with_returns": lambda t: t.build_features_with_returns(),
    "feature_null_audit": lambda t: features.feature_null_audit(t.features),
    "customers_with_returns": lambda t: features.customers_with_returns(t.features_with_returns),
    "feature_row_count": lambda t: features.feature_row_count(t.features),
    "feature_sample": lambda t: features.feature_sample(t.features),
    "customers_dim": lambda t: features.customers_dim(t.customer_lines),
    "products_dim": lambda t: features.products_dim(t.sales),
}

RFM = {
    "rfm_scores": lambda t: rfm.rfm_scores(t.rfm.drop("r_score", "f_score", "m_score")).select(
        "customer_id", "r_score", "f_score", "m_score"
    ),
    "rfm_score_code": lambda t: rfm.rfm_score_code(t.rfm.drop("rfm_score")).select(
        "customer_id", "r_score", "f_score", "m_score", "rfm_score"
    ),
    "rfm_segment": lambda t: rfm.rfm_segment(t.rfm.drop("customer_segment")).select(
        "customer_id", "rfm_score", "customer_segment"
    ),
    "customer_rfm": lambda t: rfm.customer_rfm(t.build_features()),
    "rfm_lookup": lambda t: rfm.rfm_lookup(t.rfm, t.buyers_after_cutoff),
    "segment_revenue": lambda t: rfm.segment_revenue(t.rfm),
    "segment_share": lambda t: rfm.segment_share(t.rfm),
    "segment_profile": lambda t: rfm.segment_profile(t.rfm),
    "rfm_segments": lambda t: rfm.rfm_segments(t.rfm),
    "score_distribution": lambda t: rfm.score_distribution(t.rfm),
    "top_monetary_customers": lambda t: rfm.top_monetary_customers(t.rfm),
    "most_inactive_customers": lambda t: rfm.most_inactive_customers(t.rfm),
    "one_order_customers": lambda t: rfm.one_order_customers(t.rfm),
    "order_gap_stats": lambda t: rfm.order_gap_stats(t.rfm),
    "gap_missing_by_frequency": lambda t: rfm.gap_missing_by_frequency(t.rfm),
    "return_rate_by_segment": lambda t: rfm.return_rate_by_segment(t.rfm_with_returns),
    "rfm_sample": lambda t: rfm.rfm_sample(t.rfm),
    "segment_counts": lambda t: rfm.segment_counts(t.rfm),
}

CHURN = {
    "churn_labels": lambda t: t.build_labels(),
    "label_counts": lambda t: churn.label_counts(t.labels),
    "customer_orders": lambda t: churn.customer_orders(t.monthly_customer_lines, t.cutoff),
    "order_gaps": lambda t: churn.order_gaps(churn.customer_orders(t.monthly_customer_lines, t.cutoff)),
    "churn_features": lambda t: t.build_churn_features(),
    "churn_features_exact": lambda t: churn.churn_features_exact(t.monthly_customer_lines, t.cutoff),
    "churn_feature_ranges": lambda t: churn.churn_feature_ranges(t.churn_features),
    "feature_label_counts": lambda t: churn.feature_label_counts(t.churn_features, t.labels),
    "churn_modeling": lambda t: churn.churn_modeling(t.build_churn_features(), t.build_labels()),
    "modeling_label_share": lambda t: churn.modeling_label_share(t.modeling),
    "modeling_ranges": lambda t: churn.modeling_ranges(t.modeling),
    "churn_distribution": lambda t: churn.churn_distribution(t.modeling),
    "churn_population_summary": lambda t: churn.churn_population_summary(t.modeling),
    "churn_feature_statistics": lambda t: churn.churn_feature_statistics(t.modeling),
    "feature_skew": lambda t: _rounded(churn.feature_skew(t.modeling), "skew", 6),
    "feature_histogram": lambda t: churn.feature_histogram(t.modeling),
}


# ---- sources and sinks ---------------------------------------------------------


def _text_extracts(t, faulty=False):
    """Raw lines written as two CSV extracts, one per period, numbers with a decimal point as
    spreadsheets write them; ``faulty`` plants cells that are no dates and no ids."""
    path = scratch_path(t.spark, "extracts")
    raw = t.raw.toDF(*RAW_LINES.fieldNames())
    period = F.when(F.col("InvoiceDate") < testdata.timestamp("1998-01-01"), 1).otherwise(2)
    cells = {name: F.concat(F.col(name).cast("string"), F.lit(".0")) for name in ("Quantity", "Customer ID")}
    cells["InvoiceDate"] = F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss")
    if faulty:
        cells["InvoiceDate"] = F.when(F.col("Quantity") == 13, "n/a").otherwise(cells["InvoiceDate"])
        cells["Customer ID"] = F.when(F.col("Quantity") == 17, "unknown").otherwise(cells["Customer ID"])
    raw.withColumn("period", period).withColumns(cells).write.partitionBy("period").options(**store.CSV_OPTIONS).csv(path)
    return [f"{path}/period=1", f"{path}/period=2"]


def _csv_round_trip(t, lines):
    path = scratch_path(t.spark, "clean-csv")
    store.write_clean_csv(lines, path)
    return store.read_clean_csv(t.spark, path)


def _appended(t):
    path = scratch_path(t.spark, "transactions")
    early = F.col("invoice_date") <= testdata.timestamp(t.cutoff)
    store.append_lines(t.sales.where(early), path)
    store.append_lines(t.sales.where(~early), path)
    return t.spark.read.schema(TRANSACTIONS).parquet(path)


def _materialized(t):
    path = scratch_path(t.spark, "customer-features")
    store.materialize(t.build_features(), path)
    return t.spark.read.schema(CUSTOMER_FEATURES).parquet(path)


def _joined_by_bucket(t):
    """The modelling table from two bucketed tables, joined where they lie."""
    names = {}
    for name, frame in (("features", t.build_churn_features()), ("labels", t.build_labels())):
        path = scratch_path(t.spark, f"bucketed-{name}")
        names[name] = path.rsplit("/", 1)[1].replace("-", "_")
        store.materialize(frame, names[name], "customer_id", store.JOIN_BUCKETS, path)
    return churn.churn_modeling(t.spark.table(names["features"]).hint("merge"), t.spark.table(names["labels"]))


def _upserted(t):
    root = scratch_path(t.spark, "predictions")
    store.upsert_predictions(t.spark, root, t.predictions)
    store.upsert_predictions(t.spark, root, t.fresh_predictions)
    return store.read_current(t.spark, root)


def _reloaded(t):
    path = scratch_path(t.spark, "model")
    training.save_model(t.spark, t.final, path)
    return training.load_model(t.spark, path)


SOURCES = {
    "read_raw_sheets": lambda t: cleaning.normalize_columns(store.read_raw_sheets(t.spark, _text_extracts(t))),
    "unreadable_cells": lambda t: store.unreadable_cells(store.read_raw_text(t.spark, _text_extracts(t, faulty=True))),
    "read_clean_csv": lambda t: _csv_round_trip(t, t.sales),
    "write_clean_csv": lambda t: _csv_round_trip(t, t.customer_lines),
    "prepare_lines_for_load": lambda t: store.prepare_lines_for_load(
        t.sales.withColumnsRenamed({"stock_code": "stockcode", "invoice_date": "invoicedate"})
    ),
    "append_lines": _appended,
    "materialize": _materialized,
    "bucketed_modeling": _joined_by_bucket,
    "update_columns": lambda t: store.update_columns(
        t.rfm.select("customer_id", "r_score", "f_score", "m_score"),
        {"rfm_score": F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")])},
    ),
    "upsert_predictions": _upserted,
    "read_predictions": lambda t: store.read_predictions(t.predictions),
    "table_constraints": lambda t: store.table_constraints(
        t.fresh_predictions, "customer_id", PREDICTIONS.fieldNames()[1:], t.modeling
    ),
    "save_model": lambda t: scoring.prediction_roundtrip(t.modeling, t.final, _reloaded(t)),
}


# ---- training ------------------------------------------------------------------


def _imputed(t):
    medians = training.feature_medians(t.train)
    return training.impute_median(t.modeling, medians)


def _scaled(t):
    rows = _imputed(t)
    stats = training.scaling_stats(training.impute_median(t.train, training.feature_medians(t.train)))
    scaled = training.standard_scale(rows, stats)
    return scaled.select("customer_id", *[F.round(c, 6).alias(c) for c in MODEL_FEATURES])


def _logged(t):
    logged = training.log1p_features(_imputed(t))
    return logged.select("customer_id", *[F.round(c, 9).alias(c) for c in training.LOG_FEATURES])


#: Numbers of trees after which the final model is judged.
STAGES = [1, 10, 25, 50, 100, 150, 200]


TRAINING = {
    "stratified_split": lambda t: training.stratified_split(t.modeling).select("customer_id", "churned", "is_test"),
    "split_summary": lambda t: training.split_summary(t.split),
    "impute_median": lambda t: _imputed(t).select("customer_id", *MODEL_FEATURES),
    "standard_scale": _scaled,
    "log1p_features": _logged,
    "binary_metrics": lambda t: training.binary_metrics(t.judged),
    "classification_report": lambda t: training.classification_report(t.judged),
    "confusion_matrix": lambda t: training.confusion_matrix(t.judged),
    "stratified_kfold": lambda t: training.stratified_kfold(t.train).select("customer_id", "churned", "fold"),
    "train_logistic": lambda t: checks.logistic_model(t.split, t.logistic),
    "train_logistic_log": lambda t: checks.logistic_model(t.split, t.logistic_log),
    "train_final": lambda t: checks.tree_model(t.split, t.final, training.FINAL["trees"], training.FINAL["depth"]),
    "feature_importance": lambda t: checks.importance(training.feature_importance(t.spark, t.final)),
    "model_metrics_table": lambda t: checks.metrics_table(t.model_metrics, t.split),
    "boosting_root_histogram": lambda t: boosting.root_histogram(t.train, MODEL_FEATURES),
    "staged_auc": lambda t: training.staged_auc(t.final, t.test, STAGES),
    "feature_importance_measured": lambda t: training.feature_importance(t.spark, t.final),
    "train_test_auc": lambda t: checks.sweep(t.model_aucs, t.train, t.test),
    "train_test_auc_measured": lambda t: t.model_aucs,
    "cross_validate": lambda t: checks.folds(t.logistic_folds, t.folded),
    "cross_validate_measured": lambda t: t.logistic_folds,
}

# Fits of many trees; they take minutes whatever the size of the input.
LONG_TRAINING = {
    "train_random_forest": lambda t: checks.tree_model(t.split, t.forest, training.FOREST_TREES, training.FOREST_DEPTH),
    "train_boosted": lambda t: checks.tree_model(t.split, t.boosted, training.BOOSTED["trees"], training.BOOSTED["depth"]),
    "config_sweep": lambda t: checks.sweep(t.sweep_aucs, t.train, t.test),
    "config_sweep_measured": lambda t: t.sweep_aucs,
    "cv_config_sweep": lambda t: checks.folds(t.boosted_folds, t.folded),
    "cv_config_sweep_measured": lambda t: training.cv_summary(t.boosted_folds),
}


# ---- scoring -------------------------------------------------------------------


def _driver_names(name):
    return F.array_join(F.transform(name, lambda d: d["feature"]), ", ").alias(name)


def _customer_360(t):
    rows = scoring.customer_360(
        t.buyers_after_cutoff, t.scored_customers, t.churn_features, t.rfm, t.predictions, t.linear_attributions
    )
    lists = ("churn_drivers", "protective_factors")
    return rows.select(*[c for c in rows.columns if c not in lists], *[_driver_names(c) for c in lists])


def _explained(t):
    """The lookup on the fitted model: profile, and whether a customer of the modelling table has a
    prediction, drivers that raise and factors that lower the risk, strongest first, three at most."""
    attr = scoring.attributions(t.modeling, t.final)
    rows = scoring.customer_360(t.buyers_after_cutoff, t.scored_customers, t.churn_features, t.rfm, t.model_predictions, attr)

    def holds(name, sign):
        effects = F.transform(name, lambda d: d["shap_value"] * sign)
        falling = F.array_sort(effects) == F.reverse(effects)
        return (F.size(name) <= 3) & F.forall(effects, lambda x: x > 0) & falling

    drivers = F.coalesce(holds("churn_drivers", 1), F.lit(True)) & F.coalesce(holds("protective_factors", -1), F.lit(True))
    some = F.coalesce(F.size("churn_drivers"), F.lit(0)) + F.coalesce(F.size("protective_factors"), F.lit(0)) > 0
    return rows.select(
        "customer_id", "country", *MODEL_FEATURES, "rfm_score", "customer_segment",
        F.col("churn_probability").isNotNull().alias("predicted"), some.alias("explained"), drivers.alias("drivers_hold"),
        (F.col("recommendation").isNotNull() == F.col("risk_level").isNotNull()).alias("advised"),
    )


def _ranked(rows):
    return rows.select("customer_id", "position", "feature", "feature_value", "shap_value")


SCORING = {
    "score_customers": lambda t: checks.scores(scoring.score_customers(t.modeling, t.final, testdata.SCORED_AT), t.modeling, t.final),
    "scored_prediction_coverage": lambda t: predictions.prediction_coverage(t.modeling, t.model_predictions),
    "risk_level": lambda t: scoring.risk_level(t.predictions.drop("risk_level")).select(
        "customer_id", "churn_probability", "risk_level"
    ),
    "attributions": lambda t: checks.attributions(scoring.attributions(t.modeling, t.final), t.modeling, t.final),
    "linear_attributions": lambda t: t.linear_attributions,
    "top_drivers": lambda t: _ranked(scoring.top_drivers(t.linear_attributions)),
    "protective_factors": lambda t: _ranked(scoring.protective_factors(t.linear_attributions)),
    "attribution_summary": lambda t: scoring.attribution_summary(t.linear_attributions),
    "mean_absolute_attribution": lambda t: _rounded(
        scoring.mean_absolute_attribution(t.linear_attributions), "mean_abs_shap", 6
    ),
    "recommendation": lambda t: scoring.recommendation(t.predictions).select("customer_id", "risk_level", "recommendation"),
    "customer_360": _customer_360,
    "customer_360_model": _explained,
    "customer_360_model_measured": lambda t: scoring.customer_360(
        t.buyers_after_cutoff, t.scored_customers, t.churn_features, t.rfm, t.model_predictions, scoring.attributions(t.modeling, t.final)
    ),
    "prediction_roundtrip": lambda t: scoring.prediction_roundtrip(t.modeling, t.final, _reloaded(t)),
}

def _model_reports(t):
    """Reports on the fitted model's predictions: customers each speaks of (none where that depends on
    the model), and whether its figures agree with each other."""
    stored, modeling = t.model_predictions, t.modeling
    risk = predictions.risk_distribution(stored)
    bounds = {"LOW": (0, 0.5), "MEDIUM": (0.5, 0.75), "HIGH": (0.75, 1)}
    inside = F.lit(False)
    for level, (low, high) in bounds.items():
        # stored probabilities are rounded, so one just below a bound may show the bound
        inside = inside | ((F.col("risk_level") == level) & (F.col("min_probability") >= low) & (F.col("max_probability") <= high))
    ordered = F.col("avg_probability").between(F.col("min_probability"), F.col("max_probability"))
    top, high = predictions.churn_risk_customers(stored, modeling), predictions.high_risk_customers(stored, modeling)
    greatest = stored.agg(F.max("churn_probability").cast("double")).scalar()
    shown = dashboard.display_table(high.select("churn_probability", "prediction_date"), {"churn_probability": "percent", "prediction_date": "minute"}, {})
    labels = dashboard.prediction_label(stored)
    label_holds = F.min(F.col("churn_probability") >= 0.5) == (F.min("prediction") == 1)
    parts = {
        "risk_distribution": risk.agg(F.sum("customers").alias("customers"), F.every(inside & ordered).alias("holds")),
        "churn_risk_customers": top.agg(F.count(F.lit(1)).alias("customers"), (F.max("churn_probability") == F.first(greatest)).alias("holds")),
        "high_risk_customers": high.agg(
            F.lit(None).cast("bigint").alias("customers"), F.coalesce(F.every(F.col("risk_level") == "HIGH"), F.lit(True)).alias("holds")
        ),
        "prediction_status": predictions.prediction_status(stored).select(
            F.col("prediction_count").alias("customers"),
            ((F.col("earliest_prediction") == F.col("latest_prediction")) & (F.col("latest_prediction") == testdata.timestamp(testdata.SCORED_AT))).alias("holds"),
        ),
        "risk_share": dashboard.risk_share(risk).agg(F.sum("customers").alias("customers"), (F.abs(F.sum("share") - 1) < 1e-9).alias("holds")),
        "display_table": shown.agg(
            F.lit(None).cast("bigint").alias("customers"), F.coalesce(F.every(F.col("churn_probability").endswith("%")), F.lit(True)).alias("holds")
        ),
        "prediction_label": labels.agg(F.count("prediction_text").alias("customers"), label_holds.alias("holds")),
    }
    rows = [frame.select(F.lit(name).alias("report"), F.col("customers").cast("bigint").alias("customers"), "holds") for name, frame in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


PREDICTION_REPORTS = {
    "model_prediction_reports": _model_reports,
    "model_risk_distribution": lambda t: predictions.risk_distribution(t.model_predictions),
    "model_churn_risk_customers": lambda t: predictions.churn_risk_customers(t.model_predictions, t.modeling),
    "risk_distribution": lambda t: predictions.risk_distribution(t.predictions),
    "churn_risk_customers": lambda t: predictions.churn_risk_customers(t.predictions, t.modeling),
    "high_risk_customers": lambda t: predictions.high_risk_customers(t.predictions, t.modeling),
    "prediction_status": lambda t: predictions.prediction_status(t.predictions),
    "prediction_coverage": lambda t: predictions.prediction_coverage(t.modeling, t.fresh_predictions),
}


# ---- dashboard and report package ----------------------------------------------


def _monthly(t):
    return sales.monthly_revenue_detail(t.orders)


def _high_risk_table(t):
    rows = predictions.high_risk_customers(t.predictions, t.modeling).select(
        "customer_id", "churn_probability", "risk_level", "prediction_date", "recency_days", "frequency",
        "monetary_value", "average_order_value", "total_quantity", "average_order_gap",
    )
    kinds = {
        "churn_probability": "percent",
        "prediction_date": "minute",
        "monetary_value": "currency",
        "average_order_value": "currency",
        "total_quantity": "thousands",
        "average_order_gap": "days",
    }
    names = {"recency_days": "recency", "frequency": "orders", "monetary_value": "revenue"}
    return dashboard.display_table(rows, kinds, names)


DASHBOARD = {
    "peak_months": lambda t: dashboard.peak_months(_monthly(t)),
    "monthly_series": lambda t: dashboard.monthly_series(_monthly(t)),
    "monthly_total_units": lambda t: dashboard.monthly_total_units(_monthly(t)),
    "top_countries": lambda t: dashboard.top_countries(sales.country_revenue(t.orders)),
    "product_labels": lambda t: dashboard.product_labels(sales.product_revenue(t.sold_products)),
    "product_labels_by_quantity": lambda t: dashboard.product_labels(sales.product_quantity(t.sold_products), "quantity"),
    "business_takeaways": lambda t: dashboard.business_takeaways(
        sales.country_revenue(t.orders), sales.product_revenue(t.sold_products, 1), sales.product_quantity(t.sold_products, 1)
    ),
    "risk_share": lambda t: dashboard.risk_share(predictions.risk_distribution(t.predictions)),
    "segment_overview": lambda t: dashboard.segment_overview(t.rfm),
    "behavior_comparison": lambda t: dashboard.behavior_comparison(churn.churn_feature_statistics(t.modeling)),
    "display_table": _high_risk_table,
    "prediction_label": lambda t: dashboard.prediction_label(t.predictions).select(
        "customer_id", "prediction", "prediction_text"
    ),
}


def _report_blocks(t):
    modeling = t.modeling
    down = lambda name: -F.col(name)
    return {
        "executive_kpis": (sales.executive_kpis(t.orders, modeling), []),
        "monthly_revenue": (sales.monthly_revenue(t.orders), [F.col("month")]),
        "monthly_revenue_detail": (sales.monthly_revenue_detail(t.orders), [F.col("month")]),
        "rfm_segments": (rfm.rfm_segments(t.rfm), [down("revenue"), F.col("segment")]),
        "customer_countries": (sales.customer_countries(t.customers), [down("customers"), F.col("country")]),
        "country_revenue": (sales.country_revenue(t.orders), [down("revenue"), F.col("country")]),
        "product_revenue": (sales.product_revenue(t.sold_products), [down("revenue"), F.col("stock_code"), F.col("description")]),
        "product_quantity": (sales.product_quantity(t.sold_products), [down("quantity"), F.col("stock_code"), F.col("description")]),
        "churn_model_summary": (t.model_metrics, []),
        "churn_training_summary": (churn.churn_population_summary(modeling), []),
        "churn_feature_statistics": (churn.churn_feature_statistics(modeling), [F.col("churned")]),
        "churn_risk_distribution": (predictions.risk_distribution(t.model_predictions), [F.col("min_probability")]),
        "high_risk_customers": (
            predictions.high_risk_customers(t.model_predictions, modeling), [down("churn_probability"), F.col("customer_id")]
        ),
    }


def _unsafe_numbers(t):
    """Modelling rows with NaN for a missing gap and infinity for a division by zero."""
    nan, infinity = F.lit(float("nan")), F.lit(float("inf"))
    per_gap = F.coalesce(ratio("monetary_value", F.col("frequency") - 1), infinity)
    return t.modeling.select(
        "customer_id",
        F.coalesce(F.col("average_order_gap").cast("double"), nan).alias("gap"),
        F.array(F.col("recency_days").cast("double"), per_gap).alias("measures"),
        F.struct(testdata.timestamp(testdata.SCORED_AT).alias("scored_at"), per_gap.alias("per_gap")).alias("nested"),
    )


#: What the package's blocks are checked by: a figure to add up, and whether their rows depend on a model.
_BLOCK_FIGURES = {
    "executive_kpis": "total_revenue", "monthly_revenue": "revenue", "monthly_revenue_detail": "quantity", "rfm_segments": "revenue",
    "customer_countries": "customers", "country_revenue": "revenue", "product_revenue": "revenue", "product_quantity": "quantity",
    "churn_training_summary": "total_customers", "churn_feature_statistics": "customers", "churn_risk_distribution": "customers",
    "churn_model_summary": "total_customers",
}
_MODEL_ROWS = ("churn_risk_distribution",)


def _package_figures(t):
    """Records and the sum of one figure of each block, read back from the package's texts."""
    package = report.report_package(t.spark, _report_blocks(t), "1995-01-01", t.end)
    parts = []
    for name, figure in _BLOCK_FIGURES.items():
        kind = f"array<struct<{figure}: decimal(38,2)>>"
        text = F.when(F.col(name).startswith("["), F.col(name)).otherwise(F.concat(F.lit("["), F.col(name), F.lit("]")))
        rows = F.from_json(text, kind)
        total = F.aggregate(rows, F.lit(0).cast("decimal(38,2)"), lambda sum_, row: (sum_ + row[figure]).cast("decimal(38,2)"))
        count = F.lit(None) if name in _MODEL_ROWS else F.size(rows)
        parts.append(F.struct(F.lit(name).alias("block"), count.cast("int").alias("records"), total.alias("total")))
    return package.select(F.inline(F.array(*parts)))


def _texts_with_amounts(t):
    """A text for each country with its revenue in full and in whole pounds; in two of them the full amount is off by a penny."""
    off = F.when(F.col("country").isin("NATION_2", "NATION_4"), F.lit("0.01")).otherwise(F.lit("0")).cast("decimal(3,2)")
    said = F.format_number((F.col("revenue") + off).cast("decimal(30,2)"), 2)
    whole = F.format_number(F.round("revenue", 0).cast("decimal(30,0)"), 0)
    text = F.concat(F.lit("Sales of £"), said, F.lit(" (about £ "), whole, F.lit(") in "), "country", F.lit("."))
    return sales.country_revenue(t.orders).select(F.col("country").alias("report_id"), text.alias("text"))


REPORT = {
    "report_package_figures": _package_figures,
    "report_amounts_check": lambda t: report.report_amounts_check(
        _texts_with_amounts(t), sales.country_revenue(t.orders).select(F.col("revenue").alias("amount"))
    ),
    "report_package": lambda t: report.report_package(t.spark, _report_blocks(t), "1995-01-01", t.end),
    "json_safe": lambda t: report.json_safe(_unsafe_numbers(t)).select(
        "customer_id", "gap", F.col("measures")[0].alias("recency"), F.col("measures")[1].alias("per_gap"),
        "nested.scored_at", F.col("nested.per_gap").alias("nested_per_gap"),
    ),
    "report_grounding_check": lambda t: report.report_grounding_check(
        testdata.report_texts(t.customer_lines), t.customers, t.products
    ),
}


def _bind(build):
    return lambda spark, sf_dir: build(tables(spark, sf_dir))


def all_queries():
    groups = [
        SOURCES, AUDIT, CLEANING, SALES, FEATURES, RFM, CHURN, TRAINING, SCORING, PREDICTION_REPORTS, DASHBOARD, REPORT,
        LONG_TRAINING,
    ]
    return {name: _bind(build) for group in groups for name, build in group.items()}
