"""Scalar expressions: ids, sheet names, cells, classes."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.operators import anomaly, changepoint, health, monitoring, reconcile


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()])
    return [tuple(r) for r in df.collect()]


def test_unit_names_and_match_keys(spark):
    rows = [("B 7963 TAA/ BUS 03",), ("B 7963 TAA",), ("FRK 05 A",), ("FRK 05A",), ("  X \t 1 ",)]
    got = values(spark, rows, "u string", name=text.unit_name(F.col("u")), key=text.match_key(F.col("u")))
    assert [g[0] for g in got] == ["B 7963 TAA", "B 7963 TAA", "FRK 05 A", "FRK 05A", "X 1"]
    assert got[0][1] == got[1][1] and got[2][1] == got[3][1]


def test_unit_split(spark):
    rows = [("HT 136",), ("bus12",), (" fl 3",), ("77",), ("HT",)]
    category, unit = text.split_unit(F.col("u"))
    assert values(spark, rows, "u string", c=category, i=unit) == [
        ("HEAD_TRUCK", "136"), ("BUS", "12"), ("FL", "3"), ("77", "77"), ("H", "T")]


def test_sheet_names(spark):
    rows = [("JANUARI 2025",), ("DESEMBER 2025",), ("FEBUARI 2025",), ("BULAN MISTERI 2025",), ("Mei",)]
    got = values(spark, rows, "s string", m=text.sheet_month(F.col("s")), y=text.sheet_year(F.col("s")))
    assert got == [(1, 2025), (12, 2025), (2, 2025), (None, 2025), (5, None)]


def test_cells(spark):
    rows = [("12.5",), ("12,5",), (" full ",), ("in  shop",), ("",), (None,), ("2.5d",), ("1_0",), ("-3",), ("1e3",)]
    amount, status = text.cell_value(F.col("t"))
    assert values(spark, rows, "t string", a=amount, s=status) == [
        (12.5, None), (12.5, None), (None, "FULL"), (None, "IN SHOP"), (None, None), (None, None), (None, "2.5D"),
        (None, "1_0"), (-3.0, None), (1000.0, None)]


def test_impossible_dates_are_missing(spark):
    got = values(spark, [(2025, 2, 30), (2024, 2, 29)], "y int, m int, d int",
                 d=text.date_from(F.col("y"), F.col("m"), F.col("d")))
    assert got[0][0] is None and str(got[1][0]) == "2024-02-29"


def test_severity(spark):
    rows = [(2.5, 0.1), (2.5, -0.1), (None, -0.5), (-7.0, -0.1), (1.0, -0.9), (3.0, None), (4.0, 0.0)]
    got = values(spark, rows, "z double, i double", s=anomaly.severity(F.col("z"), F.col("i")))
    assert [g[0] for g in got] == ["LOW", "MEDIUM", "NORMAL", "CRITICAL", "NORMAL", "MEDIUM", "HIGH"]


def test_difference_states(spark):
    rows = [(0.49,), (0.5,), (-2.99,), (3.0,), (-9.99,), (10.0,), (None,)]
    got = values(spark, rows, "p double", s=reconcile.difference_state(F.col("p")))
    assert [g[0] for g in got] == ["MATCH", "MINOR DIFFERENCE", "MINOR DIFFERENCE", "MAJOR DIFFERENCE",
                                   "MAJOR DIFFERENCE", "REQUIRES REVIEW", "REQUIRES REVIEW"]


def test_health_status_and_holes(spark):
    rows = [(95.0, 3), (95.0, 50), (75.0, 50), (60.0, 50), (20.0, 50), (84.5, 50), (69.5, 50), (49.5, 50)]
    got = values(spark, rows, "s double, n int", s=health.health_status(F.col("s"), F.col("n")))
    assert [g[0] for g in got] == ["INSUFFICIENT_DATA", "HEALTHY", "MONITOR", "REVIEW", "CRITICAL", "REVIEW", "REVIEW",
                                   "REVIEW"]


def test_model_health(spark):
    got = values(spark, [(5.0,), (12.0,), (20.0,), (None,)], "w double", s=monitoring.model_health(F.col("w")))
    assert [g[0] for g in got] == ["HEALTHY", "MONITOR", "RETRAIN", "INSUFFICIENT_DATA"]


@pytest.mark.parametrize("means,expected", [
    ((100.0, 120.0, 1.0, 1.0), "INCREASE"), ((100.0, 80.0, 1.0, 1.0), "DECREASE"), ((0.0, 5.0, 1.0, 1.0), "INCREASE"),
    ((100.0, 101.0, 1.0, 2.0), "VOLATILITY_INCREASE"), ((100.0, 101.0, 2.0, 1.0), "VOLATILITY_DECREASE"),
    ((100.0, 101.0, 1.0, 1.1), "MINOR_SHIFT")])
def test_change_direction(spark, means, expected):
    got = values(spark, [means], "a double, b double, c double, d double",
                 s=changepoint.change_direction(*[F.col(c) for c in "abcd"]))
    assert got == [(expected,)]
