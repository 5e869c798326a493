"""Batch jobs: raw files to stage tables, stage tables to features and models.

Each job reads parquet of the stage before it and writes its own, so a job can be
rerun alone and no lineage grows across jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.operators import classify, facts, features as ft, modeling as ml, outlets as seg, portfolio as pf, reduce as red
from stockloom.sources.io import read_any, read_parquet, write_parquet, write_then_scan

RAW_SALES = (
    "documentDate string, DocumnetNumber string, OutletID string, TerritoryID bigint, DocumentType string, ItemCode string, "
    "RouteID string, PaymentTerm string, IsDirectDistributor string, NetSales decimal(18,4), Quantity bigint, Discount double"
)


def ingest(spark: SparkSession, sales: str, product: str, region: str, out: str) -> None:
    """Clean the three delivered files."""
    write_parquet(facts.process_sales(read_any(spark, sales, RAW_SALES)), f"{out}/sales.parquet")
    write_parquet(facts.process_dimension(read_any(spark, product)), f"{out}/product.parquet")
    write_parquet(facts.process_dimension(read_any(spark, region), ["territory_id"]), f"{out}/region.parquet")


def fact_tables(spark: SparkSession, processed: str, out: str, cash: str = "cash") -> None:
    """The five fact tables. Territory and outlet tables use non-zero months; only the grid itself is filled."""
    region = read_parquet(spark, f"{processed}/region.parquet")
    enriched = facts.base_sales_enriched(
        read_parquet(spark, f"{processed}/sales.parquet"), read_parquet(spark, f"{processed}/product.parquet"), region)
    base = write_then_scan(enriched, f"{out}/base_sales_enriched.parquet")
    bounds = write_then_scan(facts.month_bounds(base), f"{out}/month_bounds.parquet")
    sparse = write_then_scan(facts.pair_months(base), f"{out}/outlet_sku_active_months.parquet")
    grid = facts.fill_months(sparse, facts.PAIR, bounds, {c: 0 for c in facts.DEMAND}, wide=True)
    grid = grid.withColumn("year", F.substring("year_month", 1, 4).cast("int"))
    write_parquet(grid, f"{out}/outlet_sku_monthly_demand.parquet", "zstd", ["year"])
    activity = write_then_scan(facts.outlet_monthly_activity(base, bounds), f"{out}/outlet_monthly_activity.parquet")
    write_parquet(facts.monthly_territory_demand(sparse, region, facts.month_spine(base)), f"{out}/monthly_territory_demand.parquet")
    write_parquet(facts.outlet_features(activity, cash), f"{out}/outlet_features.parquet")


def classes_and_segments(spark: SparkSession, stage: str, starts: int = 20) -> None:
    """SKU continuity, SKU demand classes and outlet segments."""
    sparse = read_parquet(spark, f"{stage}/outlet_sku_active_months.parquet")
    bounds = read_parquet(spark, f"{stage}/month_bounds.parquet")
    write_parquet(pf.sku_continuity(sparse, bounds), f"{stage}/sku_demand_continuity.parquet")
    write_parquet(classify.item_classification(sparse, bounds), f"{stage}/item_classification.parquet")
    outlets = read_parquet(spark, f"{stage}/outlet_features.parquet")
    write_parquet(seg.segments(outlets, starts), f"{stage}/outlet_cluster_definitions.parquet")


def feature_tables(spark: SparkSession, stage: str, start: str, end: str, base_year: int = 2015) -> None:
    """SKU and seasonal lookups and the feature table with zero-inflation features and targets, in one window pass."""
    sparse = read_parquet(spark, f"{stage}/outlet_sku_active_months.parquet")
    bounds = read_parquet(spark, f"{stage}/month_bounds.parquet")
    pairs = pf.revenue(sparse, "item_code", ["outlet_id"]).groupBy("item_code").count().withColumnRenamed("count", "n_pairs")
    write_parquet(ft.seasonal_index_of_sparse(sparse, pairs, start, end), f"{stage}/seasonal_index_lookup.parquet")
    sku = ft.enriched_sku(
        read_parquet(spark, f"{stage}/sku_demand_continuity.parquet"), read_parquet(spark, f"{stage}/item_classification.parquet"))
    write_parquet(sku, f"{stage}/enriched_sku_lookup.parquet")
    clusters = read_parquet(spark, f"{stage}/outlet_cluster_definitions.parquet")
    rows = ft.time_features(ft.base_grid(sparse, clusters, bounds, start, end), base_year)
    wide = ft.add_targets(ft.add_zero_inflation(ft.lag_rolling_features(rows)))
    write_parquet(wide, f"{stage}/features_with_targets.parquet", "zstd")


def reduced_matrix(spark: SparkSession, stage: str, limit: float = red.CORRELATION_LIMIT) -> DataFrame:
    """Active rows with outlet, SKU, seasonal and territory features, correlated features removed."""
    wide = red.active_rows(read_parquet(spark, f"{stage}/features_with_targets.parquet"))
    outlets, sku, seasonal, territory = (read_parquet(spark, f"{stage}/{name}.parquet") for name in (
        "outlet_features", "enriched_sku_lookup", "seasonal_index_lookup", "monthly_territory_demand"))
    matrix = write_then_scan(ft.with_lookups(wide, outlets, sku, seasonal, territory=territory), f"{stage}/full_modeling_matrix.parquet")
    banned = [c for group in ml.DROPPED.values() for c in group] + red.ROUTING
    names, corr = red.correlation_matrix(matrix, red.candidate_features(matrix, banned))
    _kept, dropped = red.greedy_drop(names, corr, limit)
    return write_then_scan(matrix.drop(*dropped), f"{stage}/full_reduced_modeling_matrix.parquet")


def train_cells(spark: SparkSession, stage: str, out: str, settings: ml.Settings) -> DataFrame:
    """Train, score, save and log every non-empty cell; returns the run table."""
    matrix = read_parquet(spark, f"{stage}/full_reduced_modeling_matrix.parquet")
    runs = f"{out}/runs.parquet"
    for cell in ml.grid_cells():
        done = ml.train_cell(matrix, cell, settings)
        if done is None:
            continue
        name = f"model_{cell[0]}_{cell[1].lower().replace(' ', '_')}_{cell[2].lower()}"
        for part, model in done["models"].items():
            ml.save_model(model, out, f"{name}_{part}")
        scores = ml.cell_metrics(done, settings.threshold)
        params = {f"{part}.{k}": v for part, one in done["params"].items() for k, v in one.items()}
        ml.log_run(spark, runs, name, params, {**scores, "cv_score": done["cv_score"]})
    return read_parquet(spark, runs)


