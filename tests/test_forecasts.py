import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from ledgerlens.config import LedgerConfig
from ledgerlens.operators import forecast, learned, monitoring, smoothing, trees


@pytest.fixture(scope="module")
def series(spark):
    def build(values, key="ALL", start=dt.date(2023, 1, 1)):
        rows = [(key, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "series_key string, date date, y double")

    return build


def weekly(n, noise=0.0):
    rng = np.random.default_rng(0)
    return 100 + 0.1 * np.arange(n) + 10 * (np.arange(n) % 7) + rng.normal(0, noise or 1e-9, n)


@pytest.mark.parametrize("model", forecast.BASELINES)
def test_baselines_against_a_loop(series, model):
    values = [5.0, 7.0, None, 3.0, 8.0, 1.0, 9.0, 2.0, 6.0, 4.0, None, 7.5]
    known = [np.nan if v is None else v for v in values]
    want = []
    for _ in range(10):
        width = {"moving_average_7": 7, "moving_average_30": 30}.get(model)
        step = known[-1] if model == "naive" else known[-7] if model == "seasonal_naive_7" else np.nanmean(known[-width:])
        want.append(step)
        known.append(step)
    got = forecast.forecast_path(series(values), 10, model).orderBy("step").toPandas()
    assert len(got) == 10 and got.date.iloc[0] == dt.date(2023, 1, 13)
    assert np.allclose(got.forecast.astype(float), want, equal_nan=True)


def test_unknown_model(series):
    with pytest.raises(ValueError):
        forecast.forecast_path(series([1, 2, 3]), 2, "oracle")


def test_three_regimes(series, spark):
    data = series(weekly(200, 2))
    last = dt.date(2023, 1, 1) + dt.timedelta(days=199)
    targets = spark.createDataFrame([("ALL", last - dt.timedelta(days=9)), ("ALL", last + dt.timedelta(days=30)),
                                     ("ALL", last + dt.timedelta(days=800))], "series_key string, target_date date")
    got = {r.method: r for r in forecast.forecast_for_dates(data, targets, "seasonal_naive_7").collect()}
    assert set(got) == {"historical_actual", "recursive_forecast", "climatology_fallback"}
    near, far = got["recursive_forecast"], got["climatology_fallback"]
    assert near.lower <= near.point <= near.upper and near.warning is None
    assert far.lower <= far.upper and far.warning == "beyond_reliable_horizon"
    assert got["historical_actual"].lower is None


def test_climatology_wraps_around_the_year(series, spark):
    start = dt.date(2023, 12, 20)
    data = series(range(30), start=start)
    targets = spark.createDataFrame([("ALL", dt.date(2025, 1, 1)), ("ALL", dt.date(2025, 7, 1))],
                                    "series_key string, target_date date")
    got = {r.target_date.month: r for r in forecast.climatology(data, targets).collect()}
    days = pd.date_range(start, periods=30).dayofyear.to_numpy()
    away = np.minimum(np.abs(days - 1), 365 - np.abs(days - 1))
    assert np.isclose(got[1].point, np.arange(30)[away <= 7].mean()) and got[7].n_reference_points == 30


def test_one_missing_residual_hides_the_interval(series):
    values = list(weekly(150))
    values[120] = None
    rows = forecast.backtest(series(values), "naive")
    assert rows.count() == 60 and rows.where("lower_interval IS NOT NULL").count() == 0


def test_validation_covers_each_later_day(series):
    cutoff = str(dt.date(2023, 1, 1) + dt.timedelta(days=169))
    rows = forecast.cross_year_validation(series(weekly(200)), cutoff, "seasonal_naive_7").toPandas()
    assert len(rows) == 30 and np.allclose(rows.residual, rows.actual - rows.forecast)


def test_holt_winters_learns_trend_and_season(series):
    values = weekly(140)
    ahead = forecast.forecast_path(series(values), 14, "holt_winters").orderBy("step").toPandas().forecast
    assert np.abs(ahead - weekly(154)[140:]).max() < 1.5
    assert np.isnan(smoothing.fit_forecast(np.array([1.0, np.nan]), 2)).all()
    tested = forecast.backtest(series(weekly(120, 1)), "holt_winters", LedgerConfig(backtest_days=10))
    assert tested.count() == 10


def test_fits_of_many_ends_equal_single_fits():
    values = weekly(90, 2) + np.random.default_rng(3).normal(0, 2, 90)
    ends = np.array([0, 3, 10, 40, 41, 90])
    many = smoothing.fit_forecasts(values, ends, 2)
    single = [smoothing.fit_forecasts(values[:end], np.array([end]), 2)[0] for end in ends]
    assert np.isnan(many[0]).all() and np.array_equal(many, np.array(single), equal_nan=True)


def test_tree_backtest_learns_from_earlier_days_only(spark):
    """A second series that goes on after the first has ended must not change the first one's forecasts."""
    def rows(later):
        first = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(weekly(110, 1))]
        second = [("b", dt.date(2024, 1, 1) + dt.timedelta(days=i), 20.0 if i < 98 else later) for i in range(150)]
        data = spark.createDataFrame(first + second, "series_key string, date date, y double")
        return forecast.backtest_rows(data, LedgerConfig(backtest_days=12))

    learner = RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=4, seed=1)
    got = [learned.walk_forward(rows(later), "random_forest", refit_every=12, learner=learner)
           .where("series_key = 'a'").orderBy("date").toPandas().forecast_fuel for later in (20.0, 9000.0)]
    assert len(got[0]) == 12 and got[0].notna().all() and np.array_equal(got[0], got[1])


def test_learned_model_beats_the_mean(series):
    learner = RandomForestRegressor(labelCol="y", numTrees=10, maxDepth=6, seed=1)
    ahead = learned.learned_path(series(weekly(200, 1)), 7, "random_forest", learner=learner).orderBy("step").toPandas()
    assert len(ahead) == 7 and np.abs(ahead.forecast - weekly(207)[200:]).mean() < 12
    rows = forecast.backtest_rows(series(weekly(160, 1)), LedgerConfig(backtest_days=12))
    assert learned.walk_forward(rows, "random_forest", refit_every=6, learner=learner).count() == 12
    holes = list(weekly(160, 1))
    holes[150] = None
    rows = forecast.backtest_rows(series(holes), LedgerConfig(backtest_days=12))
    tested = learned.walk_forward(rows, "random_forest", refit_every=12, learner=learner)
    assert tested.where("forecast_fuel IS NOT NULL").count() == 12
    holes[-1] = 1.0
    assert learned.learned_path(series(holes), 3, "random_forest", learner=learner).count() == 3
    with pytest.raises(ValueError):
        learned.train(series(range(35)), "random_forest", learner=learner)


def test_recursive_features_equal_the_matrix(series):
    data = series(weekly(60, 3))
    last = forecast.feature_matrix(data).orderBy(F.desc("date")).first()
    state = forecast.tails(data.where(F.col("date") < F.lit(last.date)))
    row = state.withColumns(learned.state_features(F.date_add("last_date", 1))).first()
    assert np.allclose([row[c] for c in forecast.FEATURES], [last[c] for c in forecast.FEATURES])


def test_errors_and_metrics(spark):
    rows = [("A", dt.date(2024, 1, d), a, f, 0.0, 20.0, "m") for d, (a, f) in enumerate([(10.0, 12.0), (0.0, 1.0), (None, 3.0)], 1)]
    errors = monitoring.forecast_errors(spark.createDataFrame(
        rows, "series_key string, date date, actual_fuel double, forecast_fuel double, lower_interval double, "
              "upper_interval double, model_name string"))
    got = errors.orderBy("date").collect()
    assert got[1].pct_error is None and got[2].within_interval is False and got[0].pct_error == -20.0
    assert monitoring.overall_metrics(errors).first().wape is None
    loose = monitoring.overall_metrics(errors, strict=False).first()
    assert loose.wape == 30.0 and loose.model_health_status == "RETRAIN"


def test_drift(spark):
    rows = [("A", dt.date(2024, 1, d), 30, 1.0, w, "x") for d, w in enumerate([5.0, 10.0, 13.0], 1)]
    performance = spark.createDataFrame(rows, "series_key string, date date, window_days int, rolling_mae double, "
                                              "rolling_wape double, model_health_status string")
    assert monitoring.drift_warnings(performance).first().drift is True
    assert monitoring.latest_performance(performance).first().rolling_wape == 13.0


def test_registered_backtest_of_boosting_refits_for_each_day(series, monkeypatch):
    """The registered query walks with the boosting of `trees`, which learns from one more day at each tested day."""
    from workload import runs

    asked, walk = [], trees.walk_forward

    def seen(rows, model, cfg=None):
        asked.append(model)
        return walk(rows, model, LedgerConfig() if cfg is None else cfg)

    monkeypatch.setattr(runs, "flag_series", lambda spark, d: series(weekly(140, 2)))
    monkeypatch.setattr(trees, "walk_forward", seen)
    tested = runs.QUERIES["f8_backtest_boosting"](None, "").toPandas()
    assert asked == ["hist_gradient_boosting"] and len(tested) == 60 and tested.forecast_fuel.notna().all()
    learned_from = runs.QUERIES["f8_boosting_origins"](None, "").orderBy("date").toPandas().n_learned
    assert (learned_from.diff()[1:] == 1).all()


def test_targets_hold_every_series_and_model_choice_every_model(spark, monkeypatch):
    from workload import runs

    series = spark.createDataFrame([(k, dt.date(2024, 1, 1), 1.0) for k in "ANRX"], "series_key string, date date, y double")
    days = {dt.date(2022, 1, 5), dt.date(2022, 3, 1)}
    monkeypatch.setattr(runs.b, "table", lambda *_: spark.createDataFrame([(x,) for x in days] * 2, "o_orderdate date"))
    got = [tuple(r) for r in runs.order_days(spark, "", series).collect()]
    assert sorted(got) == [(k, x) for k in "ANRX" for x in (dt.date(2024, 1, 5), dt.date(2024, 3, 1))]
    models = []
    monkeypatch.setattr(runs, "flag_series", lambda *_: series)
    monkeypatch.setattr(runs, "cut", lambda rows: rows)
    monkeypatch.setattr(forecast, "forecast_path", lambda rows, horizon, model: models.append(model) or rows)
    assert runs.f7_model_choice(spark, "").count() == 28 and len(set(models)) == 7


def one_tree(x, target, rows, depth, leaf, bins):
    """Features and bins of the inner nodes in heap order, by trying every split of every node."""
    out = {}

    def go(node, some, level):
        out[node] = (-1, 0)
        if level == depth:
            return
        best = 1e-9
        for f in range(x.shape[1]):
            for b in range(bins - 1):
                left = some[x[some, f] <= b]
                right = some[x[some, f] > b]
                if len(left) >= leaf and len(right) >= leaf:
                    gain = (target[left].sum() ** 2 / len(left) + target[right].sum() ** 2 / len(right)
                            - target[some].sum() ** 2 / len(some))
                    if gain > best + 1e-12:
                        best, out[node] = gain, (f, b)
        f, b = out[node]
        inside = x[some, f] <= b if f >= 0 else np.ones(len(some), bool)
        go(2 * node + 1, some[inside], level + 1)
        go(2 * node + 2, some[~inside], level + 1)

    go(0, rows, 0)
    return out


def test_grown_trees_take_the_best_split_of_every_node():
    rng = np.random.default_rng(12)
    x, y = rng.integers(0, 6, (80, 3)), rng.normal(size=80)
    ends = np.array([40, 61, 80])
    weight = (np.arange(80) < ends[:, None]).astype(float)
    feature, cut_at, _ = trees.grow(x, np.repeat(y[None], 3, axis=0), weight, 3, 5, 6)
    for model, end in enumerate(ends):
        want = one_tree(x, y, np.arange(end), 3, 5, 6)
        for node in range(7):
            f = feature[model, node]
            assert f == want[node][0] and (f < 0 or cut_at[model, node] == want[node][1])


def test_every_origin_learns_from_its_own_days_alone(series):
    """A change of later days does not change the forecast of a day."""
    values = weekly(160, 3)
    later = values.copy()
    later[150:] += 500
    rows = [forecast.backtest_rows(series(v), LedgerConfig(backtest_days=20)) for v in (values, later)]
    one, other = (trees.walk_forward(r, "hist_gradient_boosting").orderBy("date").toPandas() for r in rows)
    assert len(one) == 20 and one.forecast_fuel[:11].tolist() == other.forecast_fuel[:11].tolist()
    assert (one.forecast_fuel[12:] != other.forecast_fuel[12:]).any() and one.n_learned.is_monotonic_increasing
    assert np.abs(one.forecast_fuel - one.y).mean() < 15


@pytest.mark.parametrize("model", ["hist_gradient_boosting", "random_forest"])
def test_paths_follow_the_season_and_few_days_give_none(series, model):
    ahead = forecast.forecast_path(series(weekly(200, 1)), 7, model).orderBy("step").toPandas()
    want = weekly(207)[200:]
    assert np.abs(ahead.forecast - want).max() < 15 and ahead.date.iloc[0] == dt.date(2023, 7, 20)
    assert forecast.forecast_path(series(range(35)), 3, model).where("forecast IS NULL").count() == 3


def test_node_tables_give_what_the_model_gives(spark):
    rng = np.random.default_rng(13)
    x, y = rng.integers(0, 8, (90, 4)), rng.normal(size=90)
    known = trees.boost(x, y, np.array([90]))
    total = np.full(90, known.start[0])
    for feature, cut_at, value in zip(known.feature[0], known.cut[0], known.value[0]):
        for i in range(90):
            node = 0
            for _ in range(6):
                node = 2 * node + 1 + int(feature[node] >= 0 and x[i, feature[node]] > cut_at[node])
            total[i] += value[node - 63]
    assert np.allclose(known.predict(0, x), total) and np.var(y - total) < np.var(y)


def test_estimated_starts_beat_the_first_weeks():
    rng = np.random.default_rng(14)
    t = np.arange(140)
    y = 50 + 0.3 * t + np.tile([9, 0, -4, 3, -8, 2, -2], 20) + rng.normal(0, 1, 140)
    y[:14] += rng.normal(0, 12, 14)
    ends = np.array([100, 140])
    found = smoothing.fit_states(y, ends)
    for k, end in enumerate(ends):
        weights = found["weights"][k][None, None]
        given = (found["first_level"][k], found["first_trend"][k], found["first_season"][k])
        loss = smoothing._run(y, ends[k:k + 1], weights, [given])[0][0, 0]
        assert loss <= smoothing._run(y, ends[k:k + 1], weights, [smoothing._start(y[:end])])[0][0, 0] + 1e-9
        best = smoothing._estimated(y, ends[k:k + 1], weights[0])[0]
        least = smoothing._run(y, ends[k:k + 1], weights, [best])[0][0, 0]
        for _ in range(20):  # no other start is better
            other = (best[0] + rng.normal(), best[1] + rng.normal(0, .1), best[2] + rng.normal(size=7))
            assert smoothing._run(y, ends[k:k + 1], weights, [other])[0][0, 0] >= least - 1e-9


def test_a_series_with_too_few_days_has_no_nodes(spark, daily):
    series = forecast.daily_series(daily({("A", "u"): [float(i % 7) for i in range(20)]}))
    found = trees.node_table(series, "hist_gradient_boosting")
    assert found.count() == 0 and found.columns == [c.split()[0] for c in trees.NODES.split(", ")]
