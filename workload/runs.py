"""Every query: operators of the library on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens import fixed_values as fv
from ledgerlens.functions.text import cell_value, match_key, sheet_month, sheet_year, split_unit, unit_name
from ledgerlens.operators import (anomaly, changepoint, cleaning, explore, features, forecast, health, isolation,
                                  monitoring, quality, recommend, reconcile, scenarios, segments, smoothing, trees)
from ledgerlens.plans import full_run
from ledgerlens.schema import AMOUNT, CATEGORY, DATE, FORECAST_COLUMNS, UNIT, UNIT_KEY
from ledgerlens.scratch import cut, new_path, stored
from ledgerlens.sources import grid, ledger, vendor
from ledgerlens.streaming import ingest
from workload import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
AS_OF = "2026-01-15"
CUTOFF = "2000-12-31"


def query(function):
    QUERIES[function.__name__] = function
    return function


def shown(rows: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison."""
    return rows.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
                         for c, t in rows.dtypes])


def clean_lines(spark, d):
    return cleaning.clean(b.lines_ledger(spark, d))


def kept_lines(spark, d):
    """The cleaned lines ledger written once, for queries that read it more than once."""
    return stored(clean_lines(spark, d))


def clean_mixed(spark, d):
    return cleaning.clean(b.mixed_ledger(spark, d))


def flag_series(spark, d):
    """One daily series per return flag."""
    return forecast.daily_series(clean_lines(spark, d), F.col(CATEGORY))


def lines_report(spark, d, cleaned=None):
    return anomaly.anomaly_report(kept_lines(spark, d) if cleaned is None else cleaned, use_forest=False)


def lines_changes(spark, d, cleaned=None):
    return changepoint.change_points(clean_lines(spark, d) if cleaned is None else cleaned, method="mean_shift")


def lines_by_category(spark, d, cleaned=None):
    return reconcile.category_reconciliation(clean_lines(spark, d) if cleaned is None else cleaned,
                                             b.line_totals(spark, d), labels=b.LINE_LABELS)


def lines_health(spark, d, cleaned=None, by_category=None):
    cleaned = kept_lines(spark, d) if cleaned is None else cleaned
    by_category = lines_by_category(spark, d, cleaned) if by_category is None else by_category
    wape = monitoring.overall_metrics(monitoring.forecast_errors(
        monitoring.placeholder_forecast(forecast.daily_series(cleaned)))).select("wape").scalar()
    return health.health_scores(cleaned, anomaly.anomaly_report(cleaned, use_forest=False),
                                lines_changes(spark, d, cleaned), quality.longest_gaps(cleaned),
                                by_category, wape)


# --- sources -------------------------------------------------------------------------------------

@query
def i1_vendor_csv_scan(spark, d):
    rows = vendor.vendor_ledger(b.vendor_report(spark, d)).drop("data_status", "issue_code")
    path = new_path(spark, "vendor-csv")
    rows.write.option("header", True).csv(path)
    return shown(vendor.read_vendor_csv(spark, path))


@query
def i2_vendor_report(spark, d):
    return shown(vendor.vendor_ledger(b.vendor_report(spark, d)))


@query
def i3_unit_split(spark, d):
    category, unit = split_unit(b.vendor_unit())
    return b.table(spark, d, "events").select("event_id", category.alias(CATEGORY), unit.alias(UNIT))


def order_sheets(spark, d):
    """A sheet name per order; orders of low priority stand in sheets that are not monthly."""
    month = F.element_at(F.array(*[F.lit(m) for m in (
        "Januari", "Febuari", "MARET", "April", "may", "JUNI", "Juli", "Agustus", "September", "Oktober", "Nopember",
        "Desember")]), F.month("o_orderdate"))
    name = F.concat(F.lit(" "), month, F.lit("  "), F.year("o_orderdate").cast("string"))
    return b.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "REKAP MINGGUAN").otherwise(name).alias("sheet"))


@query
def i4_sheet_names(spark, d):
    return order_sheets(spark, d).select("o_orderkey", sheet_month(F.col("sheet")).alias("month"),
                                         sheet_year(F.col("sheet")).alias("year"))


@query
def i4_skipped_sheets(spark, d):
    return grid.read_grid(stored(b.sheet_cells(spark, d))).skipped_sheets


@query
def i5_sections(spark, d):
    cells = stored(b.sheet_cells(spark, d))
    return grid.section_intervals(cells, grid.find_sections(cells))


@query
def i6_header_days(spark, d):
    return grid.read_grid(stored(b.sheet_cells(spark, d))).header_anomalies.groupBy(
        "file", "source_sheet", "day", "dropped_col").agg(F.count(F.lit(1)).alias("n_headers"))


@query
def i7_cell_classes(spark, d):
    amount, status = cell_value(F.col("text"))
    return shown(b.raw_cells(spark, d).select("event_id", amount.alias(AMOUNT), status.alias("status_text")))


@query
def i8_grid_unpivot(spark, d):
    found = grid.read_grid(stored(b.sheet_cells(spark, d))).ledger
    return shown(found.where(F.col(CATEGORY).isin("RTGC", "HEAD_TRUCK"))
                 .select(DATE, "year", "month", CATEGORY, UNIT, AMOUNT, "status_text", "source_sheet", "source_file"))


@query
def i9_stacked_blocks(spark, d):
    found = grid.read_grid(stored(b.sheet_cells(spark, d))).ledger
    return shown(found.where(F.col(CATEGORY).isin(*fv.STACKED_LABELS)).select(DATE, CATEGORY, UNIT, AMOUNT))


@query
def i10_control_totals(spark, d):
    return shown(grid.read_grid(stored(b.sheet_cells(spark, d))).totals)


@query
def i11_grid_ledger(spark, d):
    found = cleaning.clean(grid.read_grid(stored(b.sheet_cells(spark, d))).ledger)
    return shown(found.groupBy("source_file", CATEGORY, "data_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(AMOUNT).alias("total")))


@query
def i12_hybrid_sources(spark, d):
    rows = ledger.combine_sources("hybrid", b.lines_ledger(spark, d), vendor.vendor_ledger(b.vendor_report(spark, d)))
    return shown(rows.groupBy("source_file", CATEGORY).agg(F.count(F.lit(1)).alias("n"), F.sum(AMOUNT).alias("total")))


@query
def i14_partitioned_sink(spark, d):
    path = ledger.save_ledger(clean_lines(spark, d), new_path(spark, "sink"))
    return shown(spark.read.parquet(path).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.sum(AMOUNT).alias("total")))


@query
def i15_forecast_scan(spark, d):
    rows = monitoring.placeholder_forecast(forecast.daily_series(clean_lines(spark, d)))
    path = new_path(spark, "forecasts")
    rows.select(*FORECAST_COLUMNS).write.option("header", True).csv(path)
    return shown(ledger.read_forecasts(spark, path))


# --- cleaning ------------------------------------------------------------------------------------

@query
def c1_unit_names(spark, d):
    return b.raw_cells(spark, d).select("event_id", unit_name(F.col(UNIT)).alias("unit_name"))


@query
def c2_match_keys(spark, d):
    return b.raw_cells(spark, d).select("event_id", match_key(F.col(UNIT)).alias("match_key"))


@query
def c3_high_limits(spark, d):
    return shown(cleaning.high_limits(cleaning.standardised(b.mixed_ledger(spark, d))))


@query
def c4_repeated_keys(spark, d):
    return cleaning.repeated_keys(cleaning.standardised(b.mixed_ledger(spark, d)))


@query
def c5_flags(spark, d):
    return clean_mixed(spark, d).groupBy("data_status").agg(
        F.count_if(F.col(DATE).isNull()).alias("n_no_date"), F.count_if(F.col(AMOUNT) < 0).alias("n_negative"),
        F.count_if(F.col("status_text").isNotNull() & ~F.col("status_text").isin(*fv.STATUS_TOKENS)).alias("n_unknown"))


@query
def c6_row_status(spark, d):
    return clean_mixed(spark, d).select("source_row", "data_status", "issue_code")


@query
def c7_cleaned_ledger(spark, d):
    return shown(clean_mixed(spark, d))


@query
def c7_cleaned_lines(spark, d):
    return shown(clean_lines(spark, d))


@query
def c8_unit_master(spark, d):
    return cleaning.unit_master(clean_mixed(spark, d))


@query
def c8_variant_members(spark, d):
    return cleaning.variant_members(clean_mixed(spark, d))


@query
def c9_issue_report(spark, d):
    return cleaning.issue_report(clean_mixed(spark, d))


# --- data quality and reconciliation -------------------------------------------------------------

@query
def d1_missing_days(spark, d):
    return quality.missing_days(clean_lines(spark, d))


@query
def d1_missing_runs(spark, d):
    """Days without rows, as runs, of a ledger that has a day a month, and one date far off."""
    rows = b.planted_ledger(spark, d)
    far = rows.limit(1).withColumn(DATE, F.make_date(F.lit(9999), F.lit(12), F.lit(31)))
    return quality.missing_runs(cleaning.clean(rows.unionByName(far)))


@query
def d2_longest_gaps(spark, d):
    return quality.longest_gaps(clean_lines(spark, d))


@query
def d3_quality_kpis(spark, d):
    cleaned = cut(clean_mixed(spark, d))
    totals = monthly_events_totals(spark, d)
    return quality.quality_kpis(cleaned, reconcile.monthly_reconciliation(cleaned, totals),
                                quality.longest_gaps(cleaned))


def monthly_events_totals(spark, d):
    """Grand totals per day as the sum of all event values."""
    date = F.to_date("ts")
    return b.table(spark, d, "events").groupBy(date.alias(DATE)).agg(F.sum("value").alias("workbook_value")).select(
        F.year(DATE).alias("year"), F.month(DATE).alias("month"), F.lit(fv.GRAND_TOTAL).alias("category_label"),
        "workbook_value")


def sales_read(spark, d):
    """The cleaned sales ledger and its reported totals, from joined rows that are written once."""
    sales = stored(b.sales_ledger(spark, d))
    return cleaning.clean(sales), stored(b.sales_totals(spark, d, sales))


def sales_monthly(spark, d):
    return reconcile.monthly_reconciliation(*sales_read(spark, d))


def sales_by_category(spark, d):
    return reconcile.category_reconciliation(*sales_read(spark, d), labels=b.SEGMENT_LABELS)


@query
def r1_difference_states(spark, d):
    rows = b.table(spark, d, "lineitem")
    pct = F.col("l_tax") * 100 + F.col("l_discount") * 100 - 5
    return rows.groupBy(reconcile.difference_state(F.round(pct, 2)).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query
def r2_monthly_reconciliation(spark, d):
    return shown(sales_monthly(spark, d), 2)


@query
def r3_category_reconciliation(spark, d):
    return shown(sales_by_category(spark, d), 2)


@query
def r4_reconciliation_summary(spark, d):
    cleaned, totals = sales_read(spark, d)
    cleaned = stored(cleaned.select("year", "month", CATEGORY, AMOUNT, "data_status"))
    rows = reconcile.reconciliation_summary(
        reconcile.monthly_reconciliation(cleaned, totals),
        stored(reconcile.category_reconciliation(cleaned, totals, labels=b.SEGMENT_LABELS)))
    return shown(rows.withColumn("months_with_major_difference", F.array_join("months_with_major_difference", ", ")), 2)


@query
def u16_by_severity(spark, d):
    return shown(reconcile.by_severity(sales_by_category(spark, d)).select(
        "year", "month", CATEGORY, "validation_status", "severity_rank"))


@query
def u17_top_gaps(spark, d):
    return quality.top_gaps(quality.longest_gaps(clean_lines(spark, d)))


# --- features ------------------------------------------------------------------------------------

def feature_query(name: str, *columns: str):
    def run(spark, d):
        return shown(features.unit_features(kept_lines(spark, d)).select(*UNIT_KEY, DATE, *columns), 8)

    run.__name__ = name
    return query(run)


FEATURE_QUERIES = {
    "w1_lags": ("lag_1", "lag_7"),
    "w2_changes": ("difference_1", "percentage_change"),
    "w3_trailing_means": ("rolling_mean_7", "rolling_mean_14", "rolling_mean_30"),
    "w4_trailing_median": ("rolling_median_7",),
    "w5_trailing_std": ("rolling_std_7",),
    "w6_trailing_mad": ("rolling_mad_7",),
    "w7_expanding_mean": ("equipment_mean",),
    "w8_category_median": ("category_median",),
    "w9_deviations": ("deviation_from_equipment_mean", "deviation_from_category_median"),
    "w10_calendar": ("day_of_week", "month_num"),
    "w11_sufficiency": ("n_observations", "sufficient"),
}
for _name, _columns in FEATURE_QUERIES.items():
    feature_query(_name, *_columns)


# --- anomalies -----------------------------------------------------------------------------------

@query
def a1_robust_z(spark, d):
    return shown(lines_report(spark, d).select(*UNIT_KEY, DATE, "robust_z_score"))


@query
def a2_isolation_forest(spark, d):
    rows = isolation.isolation_scores(features.unit_features(kept_lines(spark, d)))
    return shown(rows.select(*UNIT_KEY, DATE, "isolation_score"))


@query
def a2_planted_outliers(spark, d):
    """Whether each planted outlier lies beyond the share of its category that is anomalous."""
    rows = isolation.isolation_scores(features.unit_features(stored(cleaning.clean(b.spiked_ledger(spark, d)))))
    planted = (F.floor(F.col("source_row") / 10) % 101 == 0) & (F.col("source_row") % 10 == 1)
    return rows.where(planted & F.col("isolation_score").isNotNull()).select(
        *UNIT_KEY, DATE, AMOUNT, (F.col("isolation_score") < 0).alias("found"))


@query
def a2_contamination_share(spark, d):
    """Rows scored per category, and whether the zero point lies at the wanted share of them."""
    rows = isolation.isolation_scores(features.unit_features(kept_lines(spark, d)))
    rank = F.ceil(F.count("isolation_score").cast("double") * 0.03 - 0.03)
    return rows.groupBy(CATEGORY).agg(
        F.count("isolation_score").alias("n_scored"),
        ((F.count_if(F.col("isolation_score") < 0) <= rank) & (F.count_if(F.col("isolation_score") <= 0) >= rank)).alias("at_share"))


@query
def a3_severity(spark, d):
    return lines_report(spark, d).select(*UNIT_KEY, DATE, "severity")


@query
def a4_types_and_reasons(spark, d):
    return lines_report(spark, d).select(*UNIT_KEY, DATE, "anomaly_type", "anomaly_reason")


@query
def a5_anomaly_report(spark, d):
    return shown(lines_report(spark, d).drop("isolation_score"))


@query
def a5_anomaly_report_events(spark, d):
    cleaned = cleaning.clean(b.events_ledger(spark, d))
    return shown(anomaly.anomaly_report(cleaned, use_forest=False).drop("isolation_score"))


@query
def a5_anomaly_report_with_forest(spark, d):
    return shown(anomaly.anomaly_report(kept_lines(spark, d)))


@query
def a6_anomaly_summary(spark, d):
    return anomaly.anomaly_summary(lines_report(spark, d))


@query
def a7_peer_comparison(spark, d):
    return shown(anomaly.peer_comparison(cleaning.clean(b.events_ledger(spark, d)), "2024-01-05", "2024-01-12"))


# --- change points -------------------------------------------------------------------------------

@query
def p1_kernel_change_points(spark, d):
    return shown(changepoint.change_points(clean_lines(spark, d)))


@query
def p1_planted_breaks(spark, d):
    return shown(changepoint.change_points(cleaning.clean(b.planted_ledger(spark, d))))


@query
def p2_segment_statistics(spark, d):
    marked = changepoint.mean_shift_scan(changepoint.unit_series(clean_lines(spark, d)))
    return shown(changepoint.segment_changes(marked).select(
        *UNIT_KEY, "change_date", "before_mean", "after_mean", "before_std", "after_std", "absolute_change",
        "percentage_change", "n_obs_before", "n_obs_after"))


@query
def p3_shift_confirmation(spark, d):
    marked = changepoint.mean_shift_scan(changepoint.unit_series(clean_lines(spark, d)))
    return marked.select(*UNIT_KEY, DATE, "confirmed")


@query
def p4_change_direction(spark, d):
    return lines_changes(spark, d).select(*UNIT_KEY, "change_date", "change_direction")


@query
def p5_change_confidence(spark, d):
    return lines_changes(spark, d).select(*UNIT_KEY, "change_date", "confidence")


@query
def p6_change_report(spark, d):
    return shown(lines_changes(spark, d))


@query
def p6_skipped_units(spark, d):
    return changepoint.skipped_units(cleaning.clean(b.events_ledger(spark, d)))


@query
def p7_change_summary(spark, d):
    return changepoint.change_summary(lines_changes(spark, d))


@query
def p8_mean_shift_scan(spark, d):
    marked = changepoint.mean_shift_scan(changepoint.unit_series(clean_lines(spark, d)))
    return marked.select(*UNIT_KEY, DATE, "position", "is_change")


# --- health --------------------------------------------------------------------------------------

@query
def h1_base_stats(spark, d):
    return shown(health.base_stats(clean_lines(spark, d)))


@query
def h2_anomaly_component(spark, d):
    return shown(health.anomaly_component(lines_report(spark, d)))


@query
def h3_volatility_rank(spark, d):
    return shown(health.volatility_component(cut(health.base_stats(clean_lines(spark, d)))))


@query
def h4_trend_penalty(spark, d):
    stats = health.base_stats(clean_lines(spark, d))
    return shown(stats.select(*UNIT_KEY, health.trend_penalty(F.col("trend_percentage")).alias("trend_penalty")))


@query
def h5_change_component(spark, d):
    return shown(health.change_component(lines_changes(spark, d)))


@query
def h6_gap_penalty(spark, d):
    gaps = quality.longest_gaps(clean_lines(spark, d))
    return shown(gaps.select(*UNIT_KEY, health.gap_penalty(F.col("longest_gap_days")).alias("missing_data_penalty")))


@query
def h7_reconciliation_component(spark, d):
    return shown(health.reconciliation_component(lines_by_category(spark, d)))


@query
def h8_forecast_penalty(spark, d):
    errors = monitoring.forecast_errors(monitoring.placeholder_forecast(flag_series(spark, d)))
    rows = monitoring.overall_metrics(errors)
    return shown(rows.select("series_key", health.forecast_penalty(F.col("wape")).alias("forecast_error_penalty")))


@query
def h9_health_scores(spark, d):
    return shown(lines_health(spark, d))


@query
def h10_health_status(spark, d):
    return lines_health(spark, d).groupBy(CATEGORY, "health_status").agg(F.count(F.lit(1)).alias("n"))


@query
def h11_recommended_action(spark, d):
    return lines_health(spark, d).select(*UNIT_KEY, "recommended_action")


# --- segments ------------------------------------------------------------------------------------

def line_profiles(spark, d):
    cleaned = kept_lines(spark, d)
    return cut(segments.unit_profiles(cleaned, anomaly.anomaly_report(cleaned, use_forest=False)))


def quadrants(units):
    """Units with a cluster that follows from two features: above or below the category's middle."""
    units = cut(units)
    placed = units.join(segments.category_middles(units), CATEGORY)
    high = (F.col("mean_daily_fuel") >= F.col("mid_mean")).cast("int")
    wild = (F.col("coefficient_of_variation") >= F.col("mid_cv")).cast("int")
    return placed.withColumn("cluster_id", high * 2 + wild).drop("mid_mean", "mid_cv")


@query
def g1_unit_profiles(spark, d):
    return shown(line_profiles(spark, d))


@query
def g2_monthly_growth(spark, d):
    return shown(segments.monthly_growth(clean_lines(spark, d)))


@query
def g3_standardised_features(spark, d):
    units = segments.standardise(segments.complete_units(line_profiles(spark, d)))
    return shown(units.select(*UNIT_KEY, *[F.get("x", F.lit(i)).alias(f"z_{c}") for i, c in enumerate(segments.FEATURES)]))


@query
def g4_k_means(spark, d):
    points = cut(segments.standardise(segments.complete_units(line_profiles(spark, d))).select(*UNIT_KEY, "x"))
    return segments.k_means(points).groupBy(CATEGORY, "k", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query
def g4_nearest_centres(spark, d):
    """Whether each unit lies in the cluster with the nearest mean, for every k."""
    points = stored(segments.standardise(segments.complete_units(line_profiles(spark, d))).select(*UNIT_KEY, "x"))
    found = stored(segments.k_means(points))
    means = found.groupBy(CATEGORY, "k", "cluster").agg(
        F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(len(segments.FEATURES))]).alias("at"))
    packed = means.groupBy(CATEGORY, "k").agg(F.collect_list(F.struct("cluster", "at")).alias("means"))

    def away(c):
        return F.aggregate(F.zip_with("x", c["at"], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)

    own = F.filter("means", lambda c: c["cluster"] == F.col("cluster"))
    nearest = away(F.get(own, F.lit(0))) <= F.array_min(F.transform("means", away)) + 1e-5
    return found.join(packed, [CATEGORY, "k"]).select(*UNIT_KEY, "k", F.size("means").alias("n_clusters"), nearest.alias("nearest"))


@query
def g5_silhouette(spark, d):
    units = quadrants(segments.standardise(segments.complete_units(line_profiles(spark, d))))
    return shown(segments.silhouettes(units.select(*UNIT_KEY, "x", F.lit(4).alias("k"),
                                                   F.col("cluster_id").alias("cluster"))))


@query
def g5_squared_silhouette(spark, d):
    units = quadrants(segments.standardise(segments.complete_units(line_profiles(spark, d))))
    return shown(segments.silhouettes(units.select(*UNIT_KEY, "x", F.lit(4).alias("k"),
                                                           F.col("cluster_id").alias("cluster"))))


@query
def g6_cluster_labels(spark, d):
    units = quadrants(segments.complete_units(line_profiles(spark, d)))
    return segments.label_clusters(units).select(*UNIT_KEY, "cluster_id", "cluster_label")


@query
def g7_cluster_descriptions(spark, d):
    units = quadrants(segments.complete_units(line_profiles(spark, d)))
    return segments.label_clusters(units).select(CATEGORY, "cluster_id", "cluster_characteristics").distinct()


@query
def g8_small_categories(spark, d):
    profiles = cut(segments.unit_profiles(cut(cleaning.clean(b.suppliers_ledger(spark, d)))))
    return segments.label_units(segments.complete_units(profiles)).select(*UNIT_KEY, "cluster_id", "cluster_label")


@query
def g8_sparse_units(spark, d):
    profiles = segments.unit_profiles(cleaning.clean(b.events_ledger(spark, d)))
    return segments.sparse_units(profiles).select(*UNIT_KEY, "cluster_id", "cluster_label", "cluster_characteristics")


@query
def g9_segment_summary(spark, d):
    cleaned = kept_lines(spark, d)
    return segments.segment_summary(segments.segments(cleaned, anomaly.anomaly_report(cleaned, use_forest=False)))


@query
def g9_segments(spark, d):
    """Every unit with its features and whether it was segmented or had too few observations."""
    cleaned = kept_lines(spark, d)
    found = segments.segments(cleaned, anomaly.anomaly_report(cleaned, use_forest=False))
    few = F.col("cluster_label") == "INSUFFICIENT_DATA"
    label = F.when(few, F.lit(-1)).otherwise(F.lit(0)).alias("kind")
    known = F.col("cluster_label").isin("INTERMITTENT", "INCREASING_TREND", "HOMOGENEOUS", "HIGH_VOLATILE", "HIGH_STABLE",
                                        "LOW_VOLATILE", "LOW_STABLE", "INSUFFICIENT_DATA")
    return shown(found.select(*UNIT_KEY, label, known.alias("labelled"), *segments.FEATURES))


# --- forecasts -----------------------------------------------------------------------------------

@query
def f1_daily_series(spark, d):
    return shown(flag_series(spark, d))


@query
def f2_training_part(spark, d):
    return shown(forecast.training_part(flag_series(spark, d), CUTOFF))


@query
def f3_feature_matrix(spark, d):
    return shown(forecast.feature_matrix(flag_series(spark, d)))


def baseline_query(name: str, model: str):
    def run(spark, d):
        return shown(forecast.forecast_path(flag_series(spark, d), 30, model))

    run.__name__ = name
    return query(run)


for _name, _model in (("f4_naive", "naive"), ("f4_seasonal_naive", "seasonal_naive_7"),
                      ("f4_moving_average_7", "moving_average_7"), ("f4_moving_average_30", "moving_average_30")):
    baseline_query(_name, _model)


@query
def f5_random_forest(spark, d):
    return shown(forecast.forecast_path(flag_series(spark, d), 7, "random_forest"))


@query
def f5_gradient_boosting(spark, d):
    return shown(forecast.forecast_path(flag_series(spark, d), 7, "hist_gradient_boosting"))


@query
def f6_holt_winters(spark, d):
    return shown(forecast.forecast_path(flag_series(spark, d), 30, "holt_winters"))


@query
def f6_state_rerun(spark, d):
    """Whether the recursion alone, from the fitted weights and starting state, gives the forecasts of the fit."""
    series = stored(flag_series(spark, d).where("y IS NOT NULL"))
    found = smoothing.rerun(series, stored(smoothing.fitted_states(series)), 30).withColumnRenamed("forecast", "again")
    path = forecast.forecast_path(series, 30, "holt_winters")
    same = F.abs(F.col("forecast") - F.col("again")) <= 1e-6 * F.greatest(F.abs("forecast"), F.lit(1.0))
    return path.join(found, ["series_key", DATE, "step"]).select("series_key", DATE, "step", same.alias("same"))


@query
def f7_model_choice(spark, d):
    series = cut(flag_series(spark, d))
    out = None
    for model in (*forecast.BASELINES, "holt_winters", "random_forest", "hist_gradient_boosting"):
        rows = forecast.forecast_path(series, 14, model).withColumn("model", F.lit(model))
        out = rows if out is None else out.unionByName(rows)
    return shown(out)


@query
def f8_backtest(spark, d):
    return shown(forecast.backtest(flag_series(spark, d), "moving_average_7"))


@query
def f8_backtest_seasonal(spark, d):
    return shown(forecast.backtest(flag_series(spark, d), "seasonal_naive_7"))


@query
def f8_backtest_holt_winters(spark, d):
    return shown(forecast.backtest(flag_series(spark, d), "holt_winters"))


@query
def f8_backtest_boosting(spark, d):
    return shown(forecast.backtest(flag_series(spark, d), "hist_gradient_boosting"))


@query
def f8_boosting_origins(spark, d):
    """Every tested day has a model of its own: the days that it learned from, and whether it gave a forecast."""
    tested = trees.walk_forward(forecast.backtest_rows(flag_series(spark, d)), "hist_gradient_boosting")
    return shown(tested.select("series_key", DATE, "y", "n_learned", F.col("forecast_fuel").isNotNull().alias("forecast")))


def same_by_nodes(spark, d, model):
    """All complete days, walked through the table of nodes by joins, and whether that is nearer to them than their mean."""
    series = stored(flag_series(spark, d))
    nodes = stored(trees.node_table(series, model))
    found = trees.walked(series, nodes, model)
    mean = F.avg("y").over(Window.partitionBy("series_key"))
    found = found.withColumn("mean", mean)
    fit = Window.partitionBy("series_key")
    better = (F.sum(F.pow(F.col("y") - F.col("forecast_fuel"), 2)).over(fit) < F.sum(F.pow(F.col("y") - F.col("mean"), 2)).over(fit))
    return found.select("series_key", DATE, "y", better.alias("better_than_mean"))


@query
def f5_boosting_nodes(spark, d):
    return shown(same_by_nodes(spark, d, "hist_gradient_boosting"))


@query
def f5_forest_nodes(spark, d):
    return shown(same_by_nodes(spark, d, "random_forest"))


@query
def f9_residual_quantiles(spark, d):
    return shown(forecast.residual_quantiles(forecast.one_step_forecasts(flag_series(spark, d), "naive")))


def order_days(spark, d, series):
    """Every series with every order day, moved two years ahead, as a target."""
    days = b.table(spark, d, "orders").select(F.add_months(F.to_date("o_orderdate"), 24).alias("target_date")).distinct()
    low, high = days.agg(F.min("target_date"), F.max("target_date")).first()
    between = F.explode(F.sequence(F.lit(low).cast("date"), F.lit(high).cast("date"))).alias("target_date")
    keys = series.select("series_key").distinct()
    return keys.select("series_key", between).join(days, "target_date").select("series_key", "target_date")


@query
def f10_climatology(spark, d):
    series = flag_series(spark, d)
    return shown(forecast.climatology(series, order_days(spark, d, series)))


@query
def f11_forecast_for_dates(spark, d):
    series = cut(flag_series(spark, d))
    return shown(forecast.forecast_for_dates(series, order_days(spark, d, series), "seasonal_naive_7"))


@query
def f12_cross_year_validation(spark, d):
    return shown(forecast.cross_year_validation(flag_series(spark, d), CUTOFF, "seasonal_naive_7"))


@query
def f13_validation_summary(spark, d):
    return shown(forecast.validation_summary(
        forecast.cross_year_validation(flag_series(spark, d), CUTOFF, "seasonal_naive_7")))


@query
def f14_placeholder(spark, d):
    return shown(monitoring.placeholder_forecast(flag_series(spark, d)))


def placeholder_errors(spark, d):
    return monitoring.forecast_errors(monitoring.placeholder_forecast(flag_series(spark, d)))


@query
def f15_forecast_errors(spark, d):
    return shown(placeholder_errors(spark, d))


@query
def f16_overall_metrics(spark, d):
    return shown(monitoring.overall_metrics(placeholder_errors(spark, d), strict=False))


@query
def f17_rolling_performance(spark, d):
    return shown(monitoring.rolling_performance(placeholder_errors(spark, d)))


@query
def f18_drift(spark, d):
    return shown(monitoring.drift_warnings(monitoring.rolling_performance(placeholder_errors(spark, d))))


@query
def f19_latest_performance(spark, d):
    return shown(monitoring.latest_performance(monitoring.rolling_performance(placeholder_errors(spark, d))))


@query
def f20_available_years(spark, d):
    return forecast.available_years(flag_series(spark, d))


# --- scenarios and recommendations ---------------------------------------------------------------

def fleet_scenarios(spark, d, cleaned=None):
    return scenarios.saving_scenarios(scenarios.baselines(clean_lines(spark, d) if cleaned is None else cleaned))


@query
def s1_saving_scenarios(spark, d):
    keys = [CATEGORY]
    return scenarios.saving_scenarios(scenarios.baselines(clean_lines(spark, d), keys), keys)


@query
def s2_efficiency(spark, d):
    totals = scenarios.baselines(clean_lines(spark, d), UNIT_KEY)
    suppliers = b.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias(UNIT), "s_acctbal")
    return shown(scenarios.efficiency(totals.join(suppliers, UNIT), F.col("s_acctbal"), UNIT_KEY))


def advice_query(name: str, rule):
    def run(spark, d):
        return rule(cut(lines_health(spark, d)))

    run.__name__ = name
    return query(run)


advice_query("n1_critical_and_rising", recommend.critical_and_rising)
advice_query("n2_anomalous_and_incomplete", recommend.anomalous_and_incomplete)
advice_query("n4_above_peers", recommend.above_peers)
advice_query("n6_changed_for_good", recommend.changed_for_good)
advice_query("n7_long_gap", recommend.long_gap)


@query
def n3_over_budget(spark, d):
    return recommend.over_budget(fleet_scenarios(spark, d))


@query
def n5_unreconciled(spark, d):
    return recommend.unreconciled(lines_by_category(spark, d))


def line_advice(spark, d):
    cleaned = kept_lines(spark, d)
    by_category = stored(lines_by_category(spark, d, cleaned))
    return recommend.recommendations(lines_health(spark, d, cleaned, by_category), by_category, AS_OF,
                                     fleet_scenarios(spark, d, cleaned))


@query
def n8_recommendations(spark, d):
    return line_advice(spark, d)


@query
def n9_recommendation_summary(spark, d):
    return recommend.recommendation_summary(line_advice(spark, d))


# --- drill-down ----------------------------------------------------------------------------------

def dated_lines(spark, d):
    return cleaning.dated(clean_lines(spark, d))


@query
def u1_scope(spark, d):
    rows = explore.scope(dated_lines(spark, d), ["A", "R"], start="1997-01-01", end="1999-12-31")
    return shown(rows.select(DATE, *UNIT_KEY, AMOUNT, "data_status"))


@query
def u2_scope_summary(spark, d):
    return shown(explore.scope_summary(explore.scope(dated_lines(spark, d), ["A", "R"])))


@query
def u3_monthly_totals(spark, d):
    return shown(explore.period_totals(dated_lines(spark, d), "month"))


@query
def u3_monthly_by_category(spark, d):
    return shown(explore.period_totals(dated_lines(spark, d), "month", [CATEGORY]))


@query
def u4_daily_totals(spark, d):
    return shown(explore.period_totals(dated_lines(spark, d), "day"))


@query
def u4_daily_by_unit(spark, d):
    return shown(explore.period_totals(dated_lines(spark, d), "day", UNIT_KEY))


@query
def u5_category_stats(spark, d):
    return shown(explore.category_stats(dated_lines(spark, d)))


@query
def u6_month_category_pivot(spark, d):
    return shown(explore.month_category_pivot(dated_lines(spark, d), ["A", "N"]))


@query
def u7_combined_share(spark, d):
    return shown(explore.combined_share(explore.category_stats(dated_lines(spark, d)), ["A", "N"]))


@query
def u8_top_units(spark, d):
    return shown(explore.top_units(dated_lines(spark, d)))


@query
def u9_trailing_sums(spark, d):
    series = cut(flag_series(spark, d))
    return shown(explore.trailing_sum(series, 7).join(explore.trailing_sum(series, 30), "series_key"))


@query
def u10_overview_kpis(spark, d):
    cleaned = kept_lines(spark, d)
    return explore.overview_kpis(lines_report(spark, d, cleaned), lines_health(spark, d, cleaned))


@query
def u11_anomaly_filter(spark, d):
    rows = explore.anomaly_filter(lines_report(spark, d), categories=["A", "N"], start="1996-01-01", end="2000-12-31")
    return explore.anomaly_counters(rows)


@query
def u12_contribution(spark, d):
    return explore.contribution(explore.anomaly_filter(lines_report(spark, d)))


@query
def u13_unit_timeline(spark, d):
    return shown(explore.unit_timeline(lines_report(spark, d), "7"))


@query
def u14_health_counters(spark, d):
    return shown(explore.health_counters(lines_health(spark, d)))


@query
def u14_health_counts(spark, d):
    return explore.value_counts(lines_health(spark, d), "health_status")


@query
def u14_five_numbers(spark, d):
    return shown(explore.five_numbers(cut(lines_health(spark, d))))


@query
def u15_unit_search(spark, d):
    return explore.unit_search(lines_health(spark, d), "^1", ["MONITOR", "REVIEW", "HEALTHY"], ["A", "N"]).select(
        *UNIT_KEY, "health_status")


@query
def u18_advice_counters(spark, d):
    return explore.advice_counters(explore.advice_filter(line_advice(spark, d), ["HIGH", "MEDIUM", "LOW"]))


@query
def u18_advice_by_role(spark, d):
    return explore.value_counts(line_advice(spark, d), "responsible_role")


# --- whole run and streams -----------------------------------------------------------------------

@query
def o1_full_run(spark, d):
    """Rows and checksums of all tables of a run with the methods that SQL can follow; segments by their units."""
    tables = full_run.run(b.lines_ledger(spark, d), b.line_totals(spark, d), AS_OF, labels=b.LINE_LABELS, use_forest=False,
                          change_method="mean_shift")
    tables["segment_summary"] = tables["segment_summary"].groupBy(CATEGORY).agg(F.sum("n_equipment").alias("n_equipment"))
    return full_run.summary(full_run.written(tables))


@query
def o1_full_run_learned(spark, d):
    """Rows and checksums of all tables of a run with the forest and kernel change points."""
    tables = full_run.run(b.lines_ledger(spark, d), b.line_totals(spark, d), AS_OF, labels=b.LINE_LABELS)
    return full_run.summary(full_run.written(tables))


def event_stream(spark, d):
    """The events file as a stream of ledger rows."""
    source = b.table(spark, d, "events")
    rows = spark.readStream.schema(source.schema).parquet(f"{d}/events*.parquet")
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias(DATE), F.col("event_type").alias(CATEGORY),
        F.col("user_id").cast("string").alias(UNIT), F.col("value").alias(AMOUNT),
        F.lit(None).cast("string").alias("status_text"), F.lit("stream").alias("source_sheet"),
        F.lit("events").alias("source_file"), F.col("event_id").alias("source_row"))


@query
def st1_ingest(spark, d):
    base = new_path(spark, "ingest")
    twice = event_stream(spark, d).unionByName(event_stream(spark, d))
    ingest.ingest(twice, f"{base}/table", f"{base}/state").awaitTermination()
    return shown(spark.read.parquet(f"{base}/table").select(DATE, *UNIT_KEY, AMOUNT, "source_row"))


@query
def st2_daily_totals(spark, d):
    base = new_path(spark, "totals")
    ingest.maintain_totals(event_stream(spark, d), f"{base}/table", f"{base}/state").awaitTermination()
    return shown(ingest.current_totals(spark.read.parquet(f"{base}/table")))


@query
def st3_score_arriving(spark, d):
    base = new_path(spark, "scores")
    known = b.events_ledger(spark, d)
    limits = cut(cleaning.high_limits(known))
    medians = cut(features.category_medians(known))
    rows = ingest.score_arriving(event_stream(spark, d), limits, medians)
    (rows.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return shown(spark.read.parquet(f"{base}/table").select(
        "source_row", "data_status", "deviation_from_category_median"))


