import random

from stockloom.operators import modeling as ml
from stockloom.plans import jobs


def test_jobs_from_raw_files_to_models(spark, tmp_path):
    rng = random.Random(4)
    raw, processed, stage = tmp_path / "raw", tmp_path / "processed", tmp_path / "stage"
    raw.mkdir()
    lines = ["documentDate,DocumnetNumber,OutletID,TerritoryID,DocumentType,ItemCode,RouteID,PaymentTerm,IsDirectDistributor,NetSales,Quantity,Discount"]
    number = 0
    for month in range(30):
        for outlet in range(24):
            for item in range(3):
                if rng.random() < 0.25 + 0.2 * item:
                    number += 1
                    q = rng.randint(1, 9) * (20 if outlet == 0 else 1)
                    kind, sign = ("Return", -1) if rng.random() < 0.1 else ("Invoice", 1)
                    lines.append(f"{2017 + month // 12}-{month % 12 + 1:02d}-{rng.randint(1, 28):02d},D{number},O{outlet},{outlet % 3},{kind},"
                                 f"SKU {item},R1,{'Cash' if rng.random() < 0.5 else ''},No,{sign * q * 10},{q},0")
    (raw / "sales.csv").write_text("\n".join(lines) + "\n")
    (raw / "product.csv").write_text("Item Code,Product Category ,Product line ,Brand \n" + "".join(f"SKU {k},Cat {k},Prod-Line{k},B1\n" for k in range(3)))
    (raw / "region.csv").write_text("TerritoryID,Region,District ,Province\n" + "".join(f"{k},R{k},D{k},P{k}\n" for k in range(3)))

    jobs.ingest(spark, f"{raw}/sales.csv", f"{raw}/product.csv", f"{raw}/region.csv", str(processed))
    jobs.fact_tables(spark, str(processed), str(stage))
    base = spark.read.parquet(f"{stage}/base_sales_enriched.parquet")
    assert base.count() == number and base.where("product_category is null or region is null").count() == 0
    grid = spark.read.parquet(f"{stage}/outlet_sku_monthly_demand.parquet")
    assert grid.count() == grid.select("outlet_id", "item_code").distinct().count() * 30
    jobs.classes_and_segments(spark, str(stage), starts=2)
    segments = spark.read.parquet(f"{stage}/outlet_cluster_definitions.parquet")
    assert segments.count() == 24 and segments.where("cluster_definition = 'Power'").count() == 1
    jobs.feature_tables(spark, str(stage), "2017-01", "2019-06", 2017)
    matrix = jobs.reduced_matrix(spark, str(stage))
    assert matrix.where("demand_event_rate_6m <= 0").count() == 0 if "demand_event_rate_6m" in matrix.columns else matrix.count() > 0
    whole = set(spark.read.parquet(f"{stage}/full_modeling_matrix.parquet").columns)
    assert {"outlet_total_net_sales_log", "outlet_momentum", "category_return_rate", "cluster_encoded", "terr_net_quantity", "terr_lag_qty_1m", "terr_roll_mean_qty_3m"} <= whole
    assert "grid_cell" in matrix.columns and any(c.startswith("outlet_") and c != "outlet_id" for c in matrix.columns) and any(c.startswith("terr_") for c in matrix.columns)
    territory = {(r.territory_id, r.year_month): r for r in spark.read.parquet(f"{stage}/monthly_territory_demand.parquet").collect()}
    for r in spark.read.parquet(f"{stage}/full_modeling_matrix.parquet").select("territory_id", "year_month", "terr_net_quantity", "terr_net_sales", "cluster_encoded", "demand_class_encoded", "grid_cell").collect():
        own = territory[r.territory_id, r.year_month]
        assert (r.terr_net_quantity, r.terr_net_sales) == (own.net_quantity, own.net_sales) and r.grid_cell == r.cluster_encoded * 3 + r.demand_class_encoded
    quick = ml.Settings("2018-12", "2019-01", n_iter=1, folds=2, space={"maxIter": [2], "maxDepth": [2]})
    runs = jobs.train_cells(spark, str(stage), str(tmp_path / "models"), quick)
    assert runs.select("model_name").distinct().count() >= 2
    named = {(r.model_name, r.key): r.value for r in runs.where("kind = 'metric'").collect()}
    for model in {m for m, _ in named}:
        assert {"eval_wmape", "eval_mape", "train_wmape", "train_mape", "cv_score"} <= {k for m, k in named if m == model}
    two_stage = {m for m, k in named if k == "stage1_eval_f1"}
    assert two_stage == {f"model_{n}_{c.lower().replace(' ', '_')}_{k.lower()}" for n, c, k, two in ml.grid_cells() if two} & {m for m, _ in named}
    assert {m for m, k in named if k == "stage1_eval_auc"} == two_stage
