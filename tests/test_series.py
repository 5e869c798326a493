"""Window features from arrays equal those of windows over the filled rows, and need no sort of those rows."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import facts, features as ft, reduce as red, series

MEASURES = "net_quantity bigint, net_sales decimal(28,4), gross_quantity bigint, gross_sales decimal(28,4), return_quantity bigint, return_sales decimal(28,4), n_invoices bigint, n_returns bigint"


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(11)
    rows = []
    for o in range(6):
        for k in range(4):
            for m in np.flatnonzero(rng.random(40) < (0.05, 0.3, 0.9, 0.02)[k]):
                q, back = int(rng.integers(-3, 9)), int(rng.integers(0, 3))
                sales = Decimal(int(rng.integers(-50_000, 900_000_000))).scaleb(-4)
                rows.append((f"o{o}" if o else None, f"i{k}", f"{2015 + m // 12}-{m % 12 + 1:02d}", q, sales, q + back, sales, back, Decimal(0), 1, back, f"t{o % 2}", f"cat{k % 2}"))
    return spark.createDataFrame(rows, f"outlet_id string, item_code string, year_month string, {MEASURES}, territory_id string, product_category string")


@pytest.fixture(scope="module")
def bounds(spark):
    return spark.sql("select date'2015-01-01' first_month, date'2018-04-01' last_month")


def grid(sparse, bounds):
    return facts.fill_months(sparse, facts.PAIR, bounds, {c: 0 for c in facts.DEMAND})


def plain(df):
    """The same rows without what is known of the series."""
    return df.select("*")


def ordered(df):
    key = [F.col(c).asc_nulls_first() for c in (*facts.PAIR, "year_month")]
    return df.orderBy(*key).collect()


def same(a, b):
    assert a.columns == b.columns and a.dtypes == b.dtypes
    x, y = ordered(a), ordered(b)
    assert len(x) == len(y)
    for r, s in zip(x, y, strict=True):
        for c in a.columns:
            assert (r[c] is None) == (s[c] is None), (c, r, s)
            assert r[c] == pytest.approx(s[c], rel=1e-9, abs=1e-9) if isinstance(r[c], float) else r[c] == s[c], (c, r, s)


def every(df):
    return ft.lagged(ft.add_targets(ft.add_zero_inflation(ft.lag_rolling_features(df))), "net_quantity", 12, "before")


def test_features_equal_windows(sparse, bounds):
    full = grid(sparse, bounds)
    same(every(full), every(plain(full)))
    same(ft.add_zero_inflation(full, exclude_current=True), ft.add_zero_inflation(plain(full), exclude_current=True))
    span = sparse.sparkSession.createDataFrame([(f"o{o}", "Power" if o % 3 else "Churned") for o in range(6)], "outlet_id string, cluster_definition string")
    some = ft.time_features(ft.base_grid(sparse, span, bounds, "2015-11", "2017-06"))
    same(every(some), every(plain(some)))
    same(ft.base_rows(full, span, "2015-11", "2017-06").select(*sparse.columns, "cluster_definition"), ft.base_rows(plain(full), span, "2015-11", "2017-06").select(*sparse.columns, "cluster_definition"))


def test_months_without_a_date(sparse, bounds):
    """A month that is NULL is a row of no month; the months before the first dated one then come twice, as they always did."""
    late = sparse.where("item_code = 'i1' and year_month > '2015-06'")
    full = grid(late.unionByName(late.limit(3).withColumn("year_month", F.lit(None).cast("string")).dropDuplicates(facts.PAIR)), bounds)
    same(every(full), every(plain(full)))
    key = [*facts.PAIR, "year_month"]
    got = facts.key_audit(full, key, "g").first()
    assert got == facts.key_audit(plain(full), key, "g").first() and got.surplus_rows > 0


def test_no_sort_or_window_of_filled_rows(sparse, bounds):
    """Everything after the months are exploded runs in one pass."""
    plan = every(grid(sparse, bounds))._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate ")]
    assert not any(x in above for x in ("Window", "Sort", "Exchange"))


def test_carried_columns_are_joined_before_the_fill(spark, sparse, bounds):
    clusters = spark.createDataFrame([(f"o{o}", "Power") for o in range(6)], "outlet_id string, cluster_definition string")
    features = spark.createDataFrame([(f"o{o}", float(o)) for o in range(3)], "outlet_id string, outlet_momentum double")
    rows = ft.lag_rolling_features(ft.base_grid(sparse, clusters, bounds, "2015-01", "2018-04", carry=features))
    want = ft.lag_rolling_features(plain(ft.base_grid(sparse, clusters, bounds, "2015-01", "2018-04"))).join(features, "outlet_id", "left")
    same(rows.select(*want.columns), want)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join LeftOuter" not in plan[:plan.index("Generate ")]


def test_changed_frames_are_not_taken_for_the_grid(sparse, bounds):
    full = grid(sparse, bounds)
    assert series.of(full.where("year_month > '2016-01'"), facts.PAIR) is None and series.source_of(full.limit(5)) is None
    assert facts.key_audit(full.unionByName(full), [*facts.PAIR, "year_month"], "g").first().surplus_rows == full.count()


def test_medians_only_where_a_value_is_missing(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(red, "quantiles", lambda df, columns, probs: asked.append(columns) or spark.range(1).select(*[F.lit(7.0).alias(f"{c}_p50") for c in columns]))
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None)], "a double, b double")
    assert [tuple(r) for r in red.fill_with_medians(df, ["a", "b"]).collect()] == [(1.0, 2.0), (3.0, 7.0)] and asked == [["b"]]
    assert red.fill_with_medians(df, ["a"]).count() == 2 and asked == [["b"]]
