import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from stockloom.operators import facts

SCHEMA = ("document_number string, document_date date, outlet_id string, item_code string, territory_id string, document_type string, "
          "quantity bigint, net_sales decimal(18,4), payment_term string, region string, district string, province string, "
          "product_category string, product_line string, brand string")


def line(number, day, outlet, item, kind, quantity, sales, term="cash", territory="t1"):
    return (number, dt.date.fromisoformat(day), outlet, item, territory, kind, quantity, Decimal(sales), term,
            f"r_{territory}", "d", "p", "cat", "line", "brand")


def base(spark):
    rows = [
        line("1", "2019-01-15", "o1", "a", "invoice", 5, "50"), line("2", "2019-01-20", "o1", "a", "return", -2, "-20", None),
        line("3", "2019-01-21", "o1", "b", "return", -1, "-10"),            # only returns: not in the grid
        line("4", "2019-04-02", "o1", "a", "invoice", 3, "-30", "credit"),  # positive quantity, negative sales
        line("5", "2019-04-03", "o2", "a", "invoice", 1, "10", "credit", "t2"), line("6", "2019-04-04", "o2", "a", "invoice", 1, "10", "cash", "t1"),
    ]
    return facts.with_month(spark.createDataFrame(rows, SCHEMA))


def test_grid_is_pairs_times_months(spark):
    grid = facts.outlet_sku_monthly_demand(base(spark)).collect()
    assert len(grid) == 2 * 4  # February and March have no line at all
    cells = {(r.outlet_id, r.year_month): r for r in grid}
    jan = cells["o1", "2019-01"]
    assert (jan.net_quantity, jan.gross_quantity, jan.return_quantity, jan.n_invoices, jan.n_returns) == (3, 5, 2, 1, 1)
    assert cells["o1", "2019-04"].gross_sales == Decimal("-30")
    assert cells["o2", "2019-02"].net_sales == 0
    assert {r.territory_id for r in grid if r.outlet_id == "o2"} == {"t1"}  # one territory per pair
    assert all(r.item_code == "a" for r in grid)


def test_sparse_and_full_sums_agree(spark):
    b = base(spark)
    for df in (facts.pair_months(b), facts.outlet_sku_monthly_demand(b)):
        assert df.agg(F.sum("net_quantity"), F.sum("n_returns")).first()[:] == (8, 1)


def test_activity_modal_term_and_unknown(spark):
    rows = {(r.outlet_id, r.year_month): r for r in facts.outlet_monthly_activity(base(spark)).collect()}
    assert len(rows) == 8
    assert rows["o2", "2019-04"].primary_payment_term == "cash"  # tie: smallest
    assert rows["o1", "2019-02"].primary_payment_term == "unknown"
    assert rows["o1", "2019-01"].n_unique_skus == 2


def test_territory_grid_and_pair_count(spark):
    b = base(spark)
    region = spark.createDataFrame([("t1", "r1", "d", "p"), ("t2", "r2", "d", "p"), ("t9", "r9", "d", "p")],
                                   "territory_id string, region string, district string, province string")
    out = {(r.territory_id, r.year_month): r for r in facts.monthly_territory_demand(
        facts.pair_months(b), region, facts.month_spine(b)).collect()}
    assert len(out) == 12
    assert out["t9", "2019-02"].gross_quantity == 0
    assert (out["t1", "2019-04"].n_unique_skus, out["t1", "2019-04"].n_distinct_skus) == (2, 1)


def test_outlet_features_momentum_and_churn(spark):
    months = [f"2019-{m:02d}" for m in range(1, 13)]
    rows = [("a", m, 1, 10, Decimal(10), 0, 1, 1, "cash" if m == "2019-01" else "unknown") for m in months]
    rows += [("b", m, 0, 0, Decimal(0), 0, 0, 0, "unknown") for m in months]
    rows += [("c", m, 1, 1, Decimal(1), 1, 1, 1, "cash") for m in months[-5:]]
    df = spark.createDataFrame(rows, "outlet_id string, year_month string, n_invoices bigint, gross_quantity bigint, gross_sales decimal(18,4), "
                                     "n_returns bigint, n_unique_skus bigint, n_unique_categories bigint, primary_payment_term string")
    df = df.withColumns({"territory_id": F.lit("t"), "region": F.lit("r"), "province": F.lit("p")})
    out = {r.outlet_id: r for r in facts.outlet_features(df, true_recency=True).collect()}
    assert out["a"].momentum == 30 / 90 and out["a"].loyalty_ratio == 1.0 and out["a"].pct_cash_txn == 1 / 12
    assert not out["b"].is_active and out["b"].avg_qty_per_txn == 0 and out["b"].recency_months is None
    assert out["c"].momentum == 0 and out["c"].return_rate == 0.5  # five months of history


def test_key_audit_reports_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert facts.key_audit(df, ["k"], "t").first()[1:] == (3, 1, 1)
