"""SKU demand classes from national monthly demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.functions.clean import ratio, remap

# Labels attached to each demand class.
MODEL_FAMILY = {
    "Continuous": "SARIMA(p,1,q)(P,1,Q)_12 or ETS(A,A,A)",
    "Intermittent": "Croston / SBA on deseasonalised demand",
    "Lumpy": "ADIDA + manual threshold override",
}
EVAL_METRIC = {
    "Continuous": "RMSE, MAPE (log scale), coverage probability",
    "Intermittent": "MASE, PIS (Periods in Stock), service-level simulation",
    "Lumpy": "MASE, PIS (Periods in Stock), service-level simulation",
}
SEASONAL_TREATMENT = {
    "Continuous": "SARIMA seasonal order (P,1,Q)_12; d=1 (ADF/KPSS confirmed)",
    "Intermittent": "Pre-deseasonalise with M2 national seasonal index; re-apply post-forecast",
    "Lumpy": "Aggregate to annual/bi-annual via ADIDA; disaggregate with M2 seasonal index",
}
LOG_TRANSFORM = {
    "Continuous": "Optional at national level; mandatory at outlet-SKU grain (skewness 38x)",
    "Intermittent": "Not applicable — Croston operates on intervals and sizes separately",
    "Lumpy": "Not applicable — ADIDA aggregates before estimation",
}
POLICIES = {
    "model_family": MODEL_FAMILY,
    "eval_metric": EVAL_METRIC,
    "seasonal_treatment": SEASONAL_TREATMENT,
    "log_transform_policy": LOG_TRANSFORM,
}

ACTIVE_CONTINUOUS = 0.80
CV_CONTINUOUS = 0.50
ACTIVE_LUMPY = 0.20
CV_LUMPY = 1.00


def demand_class(
    activity: Column, cv: Column,
    active_continuous: float = ACTIVE_CONTINUOUS, cv_continuous: float = CV_CONTINUOUS,
    active_lumpy: float = ACTIVE_LUMPY, cv_lumpy: float = CV_LUMPY,
) -> Column:
    return (
        F.when((activity >= active_continuous) & (cv < cv_continuous), "Continuous")
        .when((activity < active_lumpy) | (cv > cv_lumpy), "Lumpy")
        .otherwise("Intermittent")
    )


def month_count(bounds: DataFrame) -> DataFrame:
    """One row: months between the bounds, both included."""
    months = F.months_between("last_month", "first_month").cast("bigint") + 1
    return bounds.select(months.alias("total_months"))


def activity_and_cv(national: DataFrame, months: DataFrame) -> DataFrame:
    """Activity rate, demand interval and CV of non-zero months per SKU.

    ``months`` is a one-row frame ``total_months``; months missing from
    ``national`` count as zero demand.
    """
    q = F.col("gross_quantity")
    sold = F.when(q > 0, q)
    stats = national.groupBy("item_code").agg(
        F.count(sold).alias("n_active_months"),
        F.avg(sold).alias("mean_nonzero_demand"),
        F.stddev_samp(sold).alias("std_nonzero_demand"),
        F.sum(q).alias("total_quantity"),
        F.sum("gross_sales").alias("total_gross_sales"),
        F.sum("net_sales").alias("total_net_sales"),
        F.sum("return_quantity").alias("total_return_quantity"),
    )
    total, active = F.col("total_months"), F.col("n_active_months")
    cv = F.when(
        F.col("mean_nonzero_demand") > 0, F.col("std_nonzero_demand") / F.col("mean_nonzero_demand")
    ).otherwise(0.0)
    return (
        stats.crossJoin(F.broadcast(months))
        .withColumns({"activity_rate": ratio(active, total), "adi": ratio(total, active), "cv": cv})
        .withColumns({"cv2": F.col("cv") * F.col("cv"), "total_months_in_window": total})
        .drop("total_months")
    )


def classify(stats: DataFrame, **thresholds: float) -> DataFrame:
    """Demand class plus the model policy texts of that class."""
    labelled = stats.withColumn("demand_class", demand_class(F.col("activity_rate"), F.col("cv"), **thresholds))
    return labelled.withColumns({n: remap(F.col("demand_class"), t) for n, t in POLICIES.items()})


def sku_dimensions(demand: DataFrame) -> DataFrame:
    """One row of product attributes per SKU."""
    from stockloom.operators.facts import GOODS, home_attributes

    return home_attributes(demand, ["item_code"], GOODS)


def special_flags(classified: DataFrame, collapse_line: str = "prod_line3", growth_line: str = "prod_line17") -> DataFrame:
    line = F.col("product_line")
    flag = (
        F.when(line == collapse_line, "structural_collapse_trend")
        .when(line == growth_line, "bass_diffusion_short_window").otherwise("standard")
    )
    return classified.withColumn("modeling_flag", flag)


def item_classification(
    demand: DataFrame, bounds: DataFrame, collapse_line: str = "prod_line3", growth_line: str = "prod_line17",
    **thresholds: float,
) -> DataFrame:
    """The whole chain from outlet x SKU demand to flagged demand classes."""
    from stockloom.operators.facts import national_sku_demand

    stats = activity_and_cv(national_sku_demand(demand), month_count(bounds))
    joined = classify(stats, **thresholds).join(sku_dimensions(demand), "item_code", "left")
    return special_flags(joined, collapse_line, growth_line)


def class_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("demand_class").agg(F.count("*").alias("n_skus"))
