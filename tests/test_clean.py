import pytest
from pyspark.sql import functions as F

from stockloom.functions import clean
from stockloom.operators import facts
from stockloom.sources import io


@pytest.mark.parametrize("raw, want", [
    ("DocumnetNumber", "documnet_number"), ("Product line ", "product_line"), ("Item Code", "item_code"),
    ("IsDirectDistributor", "is_direct_distributor"), ("TerritoryID", "territory_id"), ("Route-ID#", "route_id"),
])
def test_snake_name(raw, want):
    assert clean.snake_name(raw) == want


def test_snake_values_keep_null_and_camel(spark):
    rows = [("\tProd-Line 3 ",), ("2019-01-05",), (None,), ("CamelCase",), ("Café Noir!",)]
    out = [r[0] for r in clean.snake_values(spark.createDataFrame(rows, "v string")).collect()]
    assert out == ["prod_line_3", "2019_01_05", None, "camelcase", "café_noir"]


def test_process_sales(spark):
    raw = spark.createDataFrame(
        [("2019-01-05", "D-1", 7, 3, "Return", "A 1", "Yes", -10.0, 4), ("2019-01-06", "D-2", 7, 3, "Invoice", "A 1", "No", 10.0, 4)],
        "documentDate string, DocumnetNumber string, OutletID int, TerritoryID int, DocumentType string, ItemCode string, "
        "IsDirectDistributor string, NetSales double, Quantity bigint")
    rows = facts.parse_month(facts.process_sales(raw)).orderBy("document_number").collect()
    assert [(r.document_number, r.outlet_id, r.quantity, r.year_month) for r in rows] == [
        ("d_1", "7", -4, "2019-01"), ("d_2", "7", 4, "2019-01")]
    assert "is_direct_distributor" not in rows[0].asDict()


def test_keep_finite_and_ratio(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert clean.keep_finite(df, ["x"]).count() == 1
    assert spark.range(1).select(clean.ratio(F.lit(1), F.lit(0)).alias("r")).first().r is None


def test_reader_and_required_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    io.export_summary(df, str(tmp_path), "t")
    for ext in ("parquet", "csv"):
        assert io.read_any(spark, f"{tmp_path}/t.{ext}").first().v == "a"
    with pytest.raises(ValueError):
        io.read_any(spark, f"{tmp_path}/t.xlsx")
    with pytest.raises(ValueError):
        io.require_columns(df, ["k", "missing"])
