"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores;
BENCH_QUERIES (comma separated) limits the list. Every query is run over its
whole input and written to Spark's no-op sink.
"""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from stockloom.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "tb2_base_sales_enriched", "tb3_outlet_sku_monthly_demand", "tb4_outlet_monthly_activity", "tb5_monthly_territory_demand",
    "tb6_outlet_features", "tb7_national_sku_demand", "cl3_demand_class", "dq1_profile", "tm9_autocorrelation",
    "tm14_pair_pattern", "pr1_pareto_sku", "ge2_outlet_gini", "os3_outlier_flags", "ft1_seasonal_index",
    "ft6_lags", "ft7_rolling_mean_std", "ft9_ratios", "ft13_months_since_purchase", "ft15_event_rates", "ft20_targets",
    "mr1_activity_filter", "ml9_mae_rmse", "ml10_auc",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus * 4)).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()  # session start-up is not part of a query
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale) if scale else None,
    }))


main()
