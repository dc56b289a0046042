import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.ranks import _counted, _keyed, _levels, group_quantiles, percent_ranks, value_ranks
from ledgerlens.operators import cleaning, quality


def statuses(df):
    return [r["data_status"] for r in df.orderBy("source_row").collect()]


def test_status_ladder(ledger):
    filler = [(f"2025-01-{i + 1:02d}", "A", f"f{i}", 10 + i % 3) for i in range(12)]
    rows = filler + [
        (None, "A", "u1", -5), ("2025-02-01", "A", "u1", -5), ("2025-02-02", "A", "u2", 9999),
        ("2025-02-02", "A", "u2 / alias", 9999), ("2025-02-03", "A", "u3", 9999), ("2025-02-04", "A", "u3", None, "ODD"),
        ("2025-02-05", "A", "u3", None, "FULL"), ("2025-02-06", "A", "u3", None), ("2025-02-07", "A", "u3", 10),
        (None, "A", "u9", 1), (None, "A", "u9", 1)]
    got = statuses(cleaning.clean(ledger(rows)))[12:]
    assert got == ["INVALID_DATE", "NEGATIVE_VALUE", "DUPLICATE", "DUPLICATE", "UNUSUALLY_HIGH", "UNKNOWN_STATUS",
                   "STATUS_ONLY", "MISSING", "VALID", "INVALID_DATE", "INVALID_DATE"]


def test_small_categories_are_never_high(ledger):
    rows = [(f"2025-01-{i + 1:02d}", "S", "u", 1) for i in range(8)] + [("2025-01-20", "S", "u", 1e6)]
    assert set(statuses(cleaning.clean(ledger(rows)))) == {"VALID"}


def test_no_row_is_dropped_and_issues_add_up(ledger):
    rng = random.Random(3)
    rows = [(f"2025-01-{rng.randint(1, 28):02d}" if rng.random() > .1 else None, rng.choice("AB"), f"u{rng.randint(1, 5)}",
             rng.choice([None, -1, 5, 7]), rng.choice([None, "FULL", "HM"])) for _ in range(300)]
    cleaned = cleaning.clean(ledger(rows)).cache()
    assert cleaned.count() == 300
    report = cleaning.issue_report(cleaned).collect()
    assert sum(r.n_occurrences for r in report) == cleaned.where("issue_code IS NOT NULL").count()
    assert all(r.data_status != "STATUS_ONLY" for r in report)


def test_unit_master_variants(ledger):
    rows = [("2025-01-01", "A", "FRK 05 A", 1), ("2025-02-01", "A", "FRK 05A", 1), ("2025-02-01", "A", "OTHER", 1),
            ("2025-01-03", "A", "FRK 05 A", 1)]
    got = {r.equipment_id: r for r in cleaning.unit_master(cleaning.clean(ledger(rows))).collect()}
    assert got["FRK 05 A"].n_variants == 1 and got["FRK 05 A"].n_records == 2
    assert got["OTHER"].n_variants == 0 and not got["OTHER"].has_possible_variant
    assert got["FRK 05A"].is_new_after_january and not got["FRK 05 A"].is_new_after_january


def test_group_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"g": ["hot"] * 4000 + ["b"] * 37 + ["one"],
                          "v": np.r_[np.round(rng.lognormal(3, 2, 4000) - 20, 2), rng.normal(size=37), 5.0]})
    got = group_quantiles(spark.createDataFrame(frame), ["g"], "v", {"a": .1, "m": .5, "z": .97}, n="n").toPandas()
    for row in got.itertuples():
        values = frame.loc[frame.g == row.g, "v"]
        assert np.allclose([row.a, row.m, row.z], values.quantile([.1, .5, .97])) and row.n == len(values)


def test_quantiles_of_close_and_extreme_values(spark):
    rng = np.random.default_rng(5)
    tiny = [5e-324, -5e-324, 1e-310, 2.0 ** -1022, 0.0, 1e308, -1e308, 2.0, np.nextafter(2.0, 0), np.nextafter(2.0, 3)]
    values = np.r_[rng.uniform(.4, .5, 3000), np.nextafter(.45, 1), rng.uniform(-1e-9, 1e-9, 300), tiny]
    frame = spark.createDataFrame(pd.DataFrame({"g": "a", "v": values}))
    wanted = {f"q{i}": p for i, p in enumerate([0, .01, .05, .1, .5, .97, 1])}
    got = group_quantiles(frame, ["g"], "v", wanted).first()
    assert [got[name] for name in wanted] == pytest.approx(list(np.quantile(values, list(wanted.values()))), rel=1e-12)
    placed = value_ranks(frame, ["g"], "v").orderBy("v").toPandas()
    assert (placed._before.to_numpy() == np.arange(len(np.unique(values)))).all()
    keys = _keyed(frame, "v").orderBy("v").toPandas()._key.to_numpy()
    assert (np.diff(keys) >= 0).all()


def test_no_window_of_a_million_values_is_large(spark):
    frame = spark.range(1_000_000).select(F.lit("a").alias("g"), (0.4 + F.col("id") * 1e-7).alias("v"))
    counted = _counted(frame, ["g"], "v")
    for depth, level in enumerate(_levels(counted, ["g"])):
        path = ["g", *[f"_p{i}" for i in range(1, depth + 1)]]
        assert level.groupBy(*path).count().agg(F.max("count")).first()[0] <= 1 << 18
    assert counted.groupBy("g", "_p1", "_p2", "_p3").count().agg(F.max("count")).first()[0] <= 4096


def test_percent_ranks_with_ties_and_missing(spark):
    frame = pd.DataFrame({"g": list("aaaaabb"), "v": [1.0, 2.0, 2.0, 3.0, None, 7.0, 7.0]})
    got = {(r.g, r.v): r.p for r in percent_ranks(spark.createDataFrame(frame), ["g"], "v", "p").collect()}
    want = frame.assign(p=frame.groupby("g").v.rank(pct=True)).dropna()
    assert all(np.isclose(got[(r.g, r.v)], r.p) for r in want.itertuples())


def test_gaps_and_missing_days(ledger):
    days = ["2025-01-01", "2025-01-20", "2025-02-08", "2025-02-09"]
    cleaned = cleaning.clean(ledger([(d, "A", "u", 1) for d in days] + [("2025-01-05", "A", "w", 1)]))
    gap = quality.longest_gaps(cleaned).collect()
    assert len(gap) == 1 and gap[0].longest_gap_days == 18
    assert str(gap[0].longest_gap_start) == "2025-01-02" and str(gap[0].longest_gap_end) == "2025-01-19"
    assert quality.missing_days(cleaned).count() == 40 - 5


def test_gaps_against_brute_force(ledger):
    rng = random.Random(5)
    base = pd.Timestamp("2025-01-01")
    rows = [((base + pd.Timedelta(days=rng.randint(0, 200))).date(), "A", f"u{rng.randint(0, 12)}", 1) for _ in range(120)]
    got = {r.equipment_id: r.longest_gap_days for r in quality.longest_gaps(cleaning.clean(ledger(rows))).collect()}
    want = {}
    for unit in {r[2] for r in rows}:
        days = sorted({r[0] for r in rows if r[2] == unit})
        longest = max([(b - a).days - 1 for a, b in zip(days, days[1:])], default=0)
        if longest >= 14:
            want[unit] = longest
    assert got == want


def test_quality_kpis_pass(ledger, spark):
    from ledgerlens.operators.reconcile import monthly_reconciliation
    cleaned = cleaning.clean(ledger([(f"2025-01-{i + 1:02d}", "A", "u", 10) for i in range(20)]))
    totals = spark.createDataFrame([(2025, 1, "GRAND_TOTAL", 200.0)],
                                   "year int, month int, category_label string, workbook_value double")
    row = quality.quality_kpis(cleaned, monthly_reconciliation(cleaned, totals), quality.longest_gaps(cleaned)).first()
    assert row.overall_status == "PASS" and row.valid_transaction_percentage == 100.0


def test_reconciliation_edges(ledger, spark):
    from ledgerlens.operators import reconcile
    cleaned = cleaning.clean(ledger([("2025-01-01", "A", "u", 100), ("2025-02-01", "A", "u", 0), ("2025-03-01", "A", "u", 5),
                                     ("2025-04-01", "A", "u", 99.505)]))
    totals = spark.createDataFrame(
        [(2025, 1, "LA", 60.0), (2025, 1, "LB", 40.0), (2025, 2, "LA", 0.0), (2025, 3, "LA", 0.0), (2025, 4, "LA", 100.0),
         (2025, 1, "GRAND_TOTAL", 100.0), (2025, 5, "GRAND_TOTAL", 7.0)],
        "year int, month int, category_label string, workbook_value double")
    by_category = reconcile.category_reconciliation(cleaned, totals, labels={"A": ["LA", "LB"]})
    assert {r.month: r.validation_status for r in by_category.collect()} == {
        1: "MATCH", 2: "NO_WORKBOOK_VALUE", 3: "REQUIRES REVIEW", 4: "MINOR DIFFERENCE"}
    monthly = {r.month: r.validation_status for r in reconcile.monthly_reconciliation(cleaned, totals).collect()}
    assert monthly == {1: "MATCH", 2: "REQUIRES REVIEW", 3: "REQUIRES REVIEW", 4: "REQUIRES REVIEW", 5: "REQUIRES REVIEW"}


def test_published_limits_are_used(ledger, spark):
    limits = spark.createDataFrame([("A", 5.0)], "equipment_category string, high_limit double")
    got = statuses(cleaning.clean(ledger([("2025-01-01", "A", "u", 4), ("2025-01-02", "A", "u", 6)]), limits=limits))
    assert got == ["VALID", "UNUSUALLY_HIGH"]


def test_a_key_with_most_rows_stays_whole(ledger):
    rows = [("2025-01-01", "A", "hot", i % 7) for i in range(600)] + [
        (f"2025-01-{1 + i % 28:02d}", "A", f"u{i}", i % 7) for i in range(300)]
    counts = {r.data_status: r["count"] for r in cleaning.clean(ledger(rows)).groupBy("data_status").count().collect()}
    assert counts == {"DUPLICATE": 600, "VALID": 300}


def test_missing_units_and_categories_are_keys_like_others(ledger):
    rows = [("2025-03-01", "C", None, 1), ("2025-03-01", "C", None, 2), ("2025-03-01", None, "U", 3),
            ("2025-03-01", None, "U", 4), ("2025-03-01", None, None, 5), ("2025-03-02", "C", None, 6)]
    got = {r.fuel_liter: r.data_status for r in cleaning.clean(ledger(rows)).collect()}
    assert [got[float(n)] for n in range(1, 7)] == ["DUPLICATE"] * 4 + ["VALID"] * 2


def test_total_counts_categories_that_are_not_listed(ledger):
    from ledgerlens.operators import explore

    rows = cleaning.clean(ledger([("2025-03-01", "A", "u", 1), ("2025-03-02", "B", "v", 10), ("2025-04-02", "B", "v", 7)]))
    got = {r.period_label: (r.A, r.TOTAL) for r in explore.month_category_pivot(rows, ["A"]).collect()}
    assert got == {"2025-03": (1.0, 11.0), "2025-04": (0.0, 7.0)}


def test_a_far_date_costs_one_run(ledger):
    rows = ledger([("2024-01-01", "A", "u", 1.0), ("2024-01-02", "A", "v", 1.0), ("2024-01-05", "A", "u", 2.0),
                   ("9999-12-31", "A", "u", 3.0), (None, "A", "u", 4.0)])
    got = [(str(r.first_day), str(r.last_day), r.n_days) for r in quality.missing_runs(cleaning.clean(rows)).orderBy("first_day").collect()]
    assert got == [("2024-01-03", "2024-01-04", 2),
                   ("2024-01-06", "9999-12-30", (dt.date(9999, 12, 31) - dt.date(2024, 1, 5)).days - 1)]
    near = cleaning.clean(rows.where("year < 9999 OR date IS NULL"))
    assert [str(r.date) for r in quality.missing_days(near).orderBy("date").collect()] == ["2024-01-03", "2024-01-04"]
    assert quality.missing_runs(cleaning.clean(ledger([]))).count() == 0
