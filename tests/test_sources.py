import pytest
from stockloom.operators import quality as dq, relational as rel
from stockloom.plans.digest import digest
from stockloom.sources import io


def test_csv_is_bound_by_its_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,extra,a\n1,x,one\n2,y,two\n")
    df = io.read_csv(spark, str(tmp_path / "a.csv"), "a string, b int")
    assert df.columns == ["a", "b"] and [tuple(r) for r in df.orderBy("b").collect()] == [("one", 1), ("two", 2)]
    with pytest.raises(ValueError, match="no column c"):
        io.read_csv(spark, str(tmp_path / "a.csv"), "a string, c int")


def test_csv_does_not_turn_bad_numbers_into_nulls(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\none,abc\n")
    with pytest.raises(Exception, match="(?i)malformed|abc"):
        io.read_csv(spark, str(tmp_path / "a.csv"), "a string, b int").collect()


def test_digest_sees_large_values(spark):
    two = [spark.createDataFrame([("k", 2.5e9 * f), ("k", -3.0)], "k string, x double") for f in (1, 1.01)]
    assert digest(two[0], ["k"], ["x"]).first() != digest(two[1], ["k"], ["x"]).first()


def test_orphans_and_months_that_are_missing(spark):
    left, right = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert [r.k for r in rel.orphans(left, right, "k").collect()] == [2]
    months = spark.createDataFrame([("2020-11",), ("2021-02",)], "year_month string")
    assert sorted(r.year_month for r in dq.missing_months(months).collect()) == ["2020-12", "2021-01"]
