"""Shapes of physical plans, and queries against their SQL."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cleaning, explore, features
from ledgerlens.scratch import cut
from workload import bindings
from workload.oracle import ORACLE
from workload.runs import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_sort_and_shuffle_once(spark):
    cleaned = cut(cleaning.clean(bindings.lines_ledger(spark, SF)))
    medians = cut(features.category_medians(cleaning.analysed(cleaned)))
    text = plan(features.unit_features(cleaned, medians=medians))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "Cartesian" not in text


def test_filters_and_columns_reach_the_scan(spark):
    rows = explore.scope(bindings.lines_ledger(spark, SF), ["A"], start="1998-01-01")
    text = plan(rows.groupBy("equipment_category").agg(F.sum("fuel_liter")))
    assert "EqualTo(l_returnflag,A)" in text and "l_extendedprice" not in text


def test_no_cartesian_products(spark):
    for name in ("c7_cleaned_lines", "d3_quality_kpis", "u5_category_stats", "r3_category_reconciliation", "f10_climatology"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_sales_are_joined_once_for_a_summary(spark, monkeypatch):
    read = []
    monkeypatch.setattr(bindings, "sales_ledger", lambda *a, f=bindings.sales_ledger: read.append(1) or f(*a))
    text = plan(QUERIES["r4_reconciliation_summary"](spark, SF))
    assert len(read) == 1 and "lineitem.parquet" not in text and "orders.parquet" not in text


def test_each_sql_names_a_query():
    assert set(ORACLE) <= set(QUERIES)


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


@pytest.mark.parametrize("name", [
    "i8_grid_unpivot", "i10_control_totals", "c7_cleaned_ledger", "c8_unit_master", "i5_sections", "d1_missing_runs", "d3_quality_kpis",
    "r4_reconciliation_summary", "a5_anomaly_report", "a7_peer_comparison", "p1_planted_breaks", "p6_change_report", "h9_health_scores",
    "g4_nearest_centres", "g5_squared_silhouette", "f5_boosting_nodes", "f6_state_rerun", "f8_boosting_origins", "f11_forecast_for_dates", "f17_rolling_performance", "n8_recommendations", "u6_month_category_pivot",
    "a2_planted_outliers", "a2_contamination_share", "o1_full_run"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    rows = QUERIES[name](spark, SF)
    result = db.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(rows.columns)
    want = [tuple(map(normal, r)) for r in result.fetchall()]
    got = [tuple(map(normal, r)) for r in rows.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
