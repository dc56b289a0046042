"""Features, anomalies, change points, health and segments on small series."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.config import LedgerConfig
from ledgerlens.operators import anomaly, changepoint, features, health, isolation, kmeans, segments
from ledgerlens.scratch import cut, stored


def by_date(df, *columns):
    return df.orderBy("equipment_category", "equipment_id", "date").select(*columns).toPandas()


def test_trailing_statistics_need_a_full_window(daily):
    got = by_date(features.unit_features(daily({("A", "u"): range(1, 13)})), "rolling_mean_7", "rolling_median_7",
                  "equipment_mean")
    assert got.rolling_mean_7[:7].isna().all() and got.rolling_mean_7[7] == 4.0 and got.rolling_median_7[7] == 4.0
    assert got.equipment_mean[:2].isna().all() and got.equipment_mean[2] == 1.5


def test_features_against_pandas(daily):
    rng = np.random.default_rng(1)
    series = {("A", "u"): rng.integers(0, 50, 60), ("A", "w"): rng.integers(0, 50, 25), ("B", "x"): rng.integers(1, 9, 40)}
    got = by_date(features.unit_features(daily(series)), "equipment_id", "fuel_liter", "lag_7", "percentage_change",
                  "rolling_std_7", "rolling_mad_7", "rolling_mean_30", "equipment_mean", "category_median")
    for (_, unit), values in series.items():
        part, s = got[got.equipment_id == unit].reset_index(drop=True), pd.Series(values, dtype=float)
        prior = s.shift(1)
        last = prior.rolling(7)
        change = (s - prior) / prior.where(prior != 0) * 100
        for column, want in {"lag_7": s.shift(7), "percentage_change": change, "rolling_std_7": last.std(ddof=0),
                             "rolling_mad_7": last.apply(lambda x: np.median(np.abs(x - np.median(x))), raw=True),
                             "rolling_mean_30": prior.rolling(30).mean(),
                             "equipment_mean": prior.expanding(2).mean()}.items():
            assert np.allclose(part[column].astype(float), want, equal_nan=True), column
    peers = np.r_[series["A", "u"], series["A", "w"]]
    assert (got[got.equipment_id == "u"].category_median == np.median(peers)).all()


def test_flat_history_then_jump(daily):
    report = by_date(anomaly.anomaly_report(daily({("A", "u"): [10.0] * 14 + [50.0], ("A", "z"): [0.0] * 16}), use_forest=False),
                     "equipment_id", "severity", "anomaly_type", "robust_z_score")
    last = report[report.equipment_id == "u"].iloc[-1]
    assert last.severity == "CRITICAL" and "HIGH_VS_OWN_PATTERN" in last.anomaly_type
    assert report[report.equipment_id == "z"].robust_z_score.isna().all()


def test_short_series_are_not_judged(daily):
    report = anomaly.anomaly_report(daily({("A", "u"): range(5)}), use_forest=False)
    assert {r.severity for r in report.collect()} == {"INSUFFICIENT_DATA"}
    summary = anomaly.anomaly_summary(report).collect()
    assert sum(r.n_records for r in summary) == 5


def test_forest_finds_planted_outliers(daily):
    rng = np.random.default_rng(2)
    values = rng.normal(100, 5, 400)
    values[[50, 200, 333]] = [400, 1, 350]
    rows = cut(isolation.isolation_scores(features.unit_features(daily({("A", "u"): values, ("B", "few"): range(20)})),
                                          LedgerConfig(forest_trees=100)))
    got = by_date(rows.where("equipment_category = 'A'"), "fuel_liter", "isolation_score")
    assert set(got.nsmallest(3, "isolation_score").fuel_liter.round()) == {400, 1, 350}
    assert abs((got.isolation_score < 0).mean() - 0.03) < 0.011
    assert rows.where("equipment_category = 'B' AND isolation_score IS NOT NULL").count() == 0
    apart = isolation.isolation_scores(features.unit_features(daily({("A", "u"): values, ("B", "few"): range(20)})),
                                       LedgerConfig(forest_trees=100), broadcast_bytes=0)
    key = ["equipment_category", "equipment_id", "date", "fuel_liter", "isolation_score"]
    assert rows.select(key).exceptAll(apart.select(key)).count() == 0 and apart.count() == rows.count()


def brute_breaks(values, penalty, min_size, jump):
    n = len(values)
    k = (values[:, None] - values[None, :]) ** 2
    typical = np.median(k[np.triu_indices(n, 1)])
    k = np.exp(-np.clip(k / (typical or 1), 1e-2, 1e2))
    np.fill_diagonal(k, 1)
    spots = [i for i in range(0, n, jump)] + [n]
    best = {0: (0.0, [])}
    for end in spots[1:]:
        tries = [(best[s][0] + (end - s) - k[s:end, s:end].sum() / (end - s) + penalty, best[s][1] + [s])
                 for s in spots if s <= end - min_size and s in best]
        if tries:
            best[end] = min(tries)
    return best[n][1][1:]


def test_kernel_breaks_are_optimal():
    rng = np.random.default_rng(4)
    for n in (30, 63, 88):
        values = np.r_[rng.normal(0, 1, n // 2), rng.normal(4, 1, n - n // 2)]
        assert changepoint.kernel_breaks(values, 2.0, 5, 5) == brute_breaks(values, 2.0, 5, 5)
    assert changepoint.kernel_breaks(np.full(40, 100.0), 5.0, 5, 5) == []


def test_typical_gap_is_the_median_of_all_pairs():
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=101), rng.integers(0, 5, 200).astype(float), np.zeros(40), rng.normal(size=2), np.array([3.0])):
        pairs = [(a - b) ** 2 for k, a in enumerate(values) for b in values[:k]]
        assert np.isclose(changepoint.typical_gap(values), np.median(pairs) if pairs else 0.0, rtol=1e-12)


def test_pruned_search_finds_every_planted_break_of_a_long_series():
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.normal(level, 1, 200) for level in (0, 6, 0, 12, 3)])
    assert changepoint.kernel_breaks(values, 5.0, 5, 5) == [200, 400, 600, 800]
    assert changepoint.kernel_breaks(values[:397], 5.0, 5, 1) == [200]


def test_change_points(daily):
    cleaned = daily({("A", "flat"): [100.0] * 40, ("A", "step"): [50.0] * 30 + [200.0] * 30, ("A", "short"): [1.0] * 10})
    for method in ("kernel", "mean_shift"):
        found = changepoint.change_points(cleaned, method=method).collect()
        assert [(r.equipment_id, r.change_direction, r.before_mean, r.after_mean) for r in found] == [
            ("step", "INCREASE", 50.0, 200.0)], method
    assert changepoint.skipped_units(cleaned).first().n_skipped == 1
    summary = changepoint.change_summary(changepoint.change_points(cleaned)).collect()
    assert sum(r.n_change_points for r in summary) == 1


def test_trend_and_volatility(daily):
    stats = cut(health.base_stats(daily({("A", "up"): [10] * 5 + [20] * 5, ("A", "few"): [1, 2], ("A", "flat"): [5] * 8})))
    rows = {r.equipment_id: r for r in stats.collect()}
    assert rows["up"].trend_percentage == 100.0 and rows["few"].trend_percentage is None
    ranks = {r.equipment_id: r.volatility_penalty for r in health.volatility_component(stats).collect()}
    assert np.isclose(ranks["flat"], 100 / 3) and sorted(ranks.values())[-1] == 100.0


def test_actions_follow_priority(spark):
    rows = [("INSUFFICIENT_DATA", 100.0, 9, 90.0, 9, 90.0), ("MONITOR", 0.0, 0, 0.0, 0, 0.0), ("HEALTHY", 0.0, 0, 0.0, 0, 0.0),
            ("HEALTHY", 60.0, 9, 0.0, 0, 0.0), ("HEALTHY", 0.0, 0, 0.0, 5, 90.0)]
    df = spark.createDataFrame(rows, "health_status string, reconciliation_penalty double, critical_anomaly_count int, "
                                     "change_point_penalty double, anomaly_count int, missing_data_penalty double")
    got = [r.a for r in df.select(health.recommended_action().alias("a")).collect()]
    assert got[0].startswith("Kumpulkan") and got[1].startswith("Monitor") and got[2] == "Tidak ada tindakan"
    assert got[3].startswith("Validasi") and got[4] == "Periksa log operasi"


def test_each_tree_takes_its_own_points(daily):
    rng = np.random.default_rng(11)
    rows = features.unit_features(daily({("A", f"u{i}"): rng.normal(50, 9, 100) for i in range(8)})).where("lag_1 IS NOT NULL")
    sizes = rows.groupBy("equipment_category").count().withColumnRenamed("count", "n_rows")
    cfg = LedgerConfig(forest_trees=20, forest_sample=64)
    drawn = isolation.drawn_points(rows, sizes, cfg).groupBy("tree").count().toPandas()
    assert len(drawn) == 20 and drawn["count"].min() >= 64 and drawn["count"].max() < 300
    forest = isolation.fit_forest(rows, sizes, cfg).toPandas()
    assert len(forest) == 20 and set(forest["sample"]) == {64} and len({tuple(c) for c in forest["cut"]}) == 20
    assert all(size[0] == 64 for size in forest["size"])


def points(spark, groups):
    rows = [(c, f"{c}{i}", [float(v) for v in x]) for c, xs in groups.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "equipment_category string, equipment_id string, x array<double>")


def wide(xs):
    return np.c_[xs, np.zeros((len(xs), 9 - xs.shape[1]))]


def test_k_means_separates_blobs_and_rejects_a_lone_outlier(spark):
    rng = np.random.default_rng(0)
    blobs = wide(np.r_[rng.normal(0, .1, (20, 2)), rng.normal(5, .1, (15, 2)), rng.normal(-5, .1, (10, 2))])
    lone = wide(np.r_[rng.normal(0, .1, (20, 2)), [[50, 50]]])
    clustered = cut(segments.k_means(points(spark, {"blobs": blobs, "lone": lone}), LedgerConfig(segment_max_k=3)))
    found = clustered.where("equipment_category = 'blobs' AND k = 3").toPandas()
    found["truth"] = [0 if v[0] < -2 else 2 if v[0] > 2 else 1 for v in found.x]
    assert found.groupby("truth").cluster.nunique().max() == 1 and found.cluster.nunique() == 3
    best = {r.equipment_category: r.k for r in segments.choose_k(clustered).collect()}
    assert best["blobs"] == 3 and best.get("lone") != 2


def lloyd(x, centres):
    """Clusters when no point moves any more."""
    while True:
        label = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(axis=1)
        new = np.array([x[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(len(centres))])
        if np.allclose(new, centres, atol=1e-12):
            return label
        centres = new


def test_bounds_give_the_clusters_of_plain_rounds(spark):
    """One start with the picks that the draw gives, against rounds that compute every distance."""
    rng = np.random.default_rng(9)
    x = np.rint(wide(rng.normal(size=(300, 4))) * kmeans.GRID) / kmeans.GRID
    rows = points(spark, {"c": x})
    picks = kmeans._picks(cut(kmeans.blocks_of(rows)), 1, 5, 42).first().picks
    found = kmeans.fit(rows, 1, 5, 42).toPandas()
    for k in range(2, 6):
        mine = found[found.k == k]
        order = mine.equipment_id.str[1:].astype(int).argsort().to_numpy()
        assert mine.cluster.to_numpy()[order].tolist() == lloyd(x, np.array([p.x for p in picks[:k]])).tolist()


def test_k_means_of_equal_points_and_of_none(spark):
    same = points(spark, {"same": wide(np.ones((9, 2))), "two": wide(np.r_[np.zeros((5, 2)), np.ones((5, 2))])})
    found = kmeans.fit(same, 3, 4, 42).toPandas()
    assert set(found.equipment_category) == {"two"} and set(found.k) == {2} and found.cluster.nunique() == 2
    assert kmeans.fit(same.where("false"), 3, 4, 42).count() == 0


def test_categories_of_few_points_settle_without_rounds(spark, monkeypatch):
    """Both ways give the same clusters, and only categories above the border need rounds between tasks."""
    rng = np.random.default_rng(12)
    rows = cut(points(spark, {"a": wide(rng.normal(size=(40, 4))), "b": wide(rng.normal(size=(90, 3))),
                              "c": wide(np.ones((3, 2)))}))
    rounds = []
    monkeypatch.setattr(kmeans, "_round", lambda *a, f=kmeans._round: rounds.append(1) or f(*a))
    found = {}
    for border in (1 << 16, 60, 0):
        monkeypatch.setattr(kmeans, "ALONE", border)
        before = len(rounds)
        found[border] = sorted(map(tuple, kmeans.fit(rows, 2, 3, 42).drop("x").collect()))
        assert (len(rounds) == before) == (border == 1 << 16)
    assert found[1 << 16] == found[60] == found[0] and len(found[0]) == 2 * 130


def test_a_large_category_settles_without_rounds_between_tasks(spark, monkeypatch):
    """More points than sixteen blocks have: a pass over tasks for each round made time grow with the number of rounds."""
    rng = np.random.default_rng(13)
    rounds = []
    monkeypatch.setattr(kmeans, "_round", lambda *a, f=kmeans._round: rounds.append(1) or f(*a))
    rows = spark.range(70_000).select(F.lit("c").alias("equipment_category"), F.col("id").cast("string").alias("equipment_id"),
                                      F.array(F.rand(1), F.randn(2)).alias("x"))
    assert kmeans.fit(rows, 2, 2, 42).groupBy("k").count().collect() == [(2, 70_000)] and not rounds


def test_bounds_give_the_clusters_of_full_rounds():
    """Also with repeated points, points half-way between centres, and centres that coincide or have no points."""
    rng = np.random.default_rng(14)
    sets = [rng.normal(size=(900, 9)), np.repeat(rng.normal(size=(30, 3)), 20, axis=0), rng.integers(-3, 4, (500, 2)).astype(float),
            np.c_[np.arange(-50.0, 51), np.zeros(101)], rng.normal(size=(300, 3)) * [1, 1e3, 1e-3], np.zeros((7, 2))]
    looked, every = [], 0
    for x in (np.rint(x * kmeans.GRID) / kmeans.GRID for x in sets):
        for k in (2, 3, 6):
            own = first = np.r_[x[:k - 1], x[:1] if k == 3 else x[-1:]]
            sums, settled = np.zeros((k, 1 + x.shape[1]), np.int64), False
            while not settled:
                new = kmeans._sums(x, kmeans._whole(x), own)
                settled, sums, own, every = (new == sums).all(), new, kmeans._moved(own, new), every + len(x)
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(kmeans, "AT_ONCE", 64)
                patch.setattr(kmeans, "_bounds", lambda *a, f=kmeans._bounds: looked.append(len(a[0])) or f(*a))
                found = kmeans._all_rounds(x, first)
            assert (found[0] == own).all() and (found[1] == sums).all()
    assert sum(looked) < every / 2 and max(looked) == 64


def test_a_round_writes_centres_not_points(spark):
    """What is kept of a round does not grow with the points, and products find the nearest centre that differences find."""
    rng = np.random.default_rng(11)
    small, large = ({"c": wide(rng.normal(size=(n, 4)))} for n in (60, 6000))
    written = []
    for groups in (small, large):
        blocks = stored(kmeans.blocks_of(points(spark, groups)))
        n = blocks.groupBy("equipment_category").agg(F.sum(F.size("units")).alias("n_points"))
        state = stored(kmeans._start_state(kmeans._picks(blocks, 2, 4, 1), n, 2, 4))
        state = kmeans._next_state(state, kmeans._round(blocks, state, 2, 4), 2, 4).first()
        written.append(sum(len(v) for v in state if isinstance(v, (bytes, bytearray))))
        assert not {"upper", "lower", "cluster"} & set(blocks.columns)
    assert written[0] == written[1]
    x = np.repeat(rng.normal(size=(50, 9)), 2, axis=0)
    centres = np.r_[x[:4], x[10:11] + 1e-9]
    assert (kmeans._nearest(x, centres) == kmeans._distances(x, centres).argmin(axis=1)).all()


def test_rounds_plan_alike_however_many_there_were(spark):
    """The size estimate of the state restarts in every round."""
    rng = np.random.default_rng(10)
    blocks, sizes = kmeans.blocks_of(points(spark, {"c": wide(rng.normal(size=(200, 3)))})), []
    blocks = stored(blocks)
    n = blocks.groupBy("equipment_category").agg(F.sum(F.size("units")).alias("n_points"))
    state = stored(kmeans._start_state(kmeans._picks(blocks, 2, 4, 1), n, 2, 4))
    for _ in range(6):
        after = stored(kmeans._round(blocks, state, 2, 4))
        state, blocks = stored(kmeans._next_state(state, after, 2, 4)), after
        sizes.append(int(blocks.join(state.drop("sums"), "equipment_category")._jdf.queryExecution().optimizedPlan()
                         .stats().sizeInBytes()))
    assert max(sizes[1:]) < 2 * min(sizes[1:])


def test_silhouettes_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x, label = wide(rng.normal(size=(30, 3))), rng.integers(0, 3, 30)
    label[:3] = [0, 1, 2]
    rows = points(spark, {"c": x}).withColumn("k", F.lit(3)).withColumn(
        "cluster", F.element_at(F.array(*[F.lit(int(v)) for v in label]), F.substring("equipment_id", 2, 9).cast("int") + 1))

    def brute(d):
        scores = []
        for i in range(len(x)):
            own = label == label[i]
            a = d[i, own].sum() / max(own.sum() - 1, 1)
            b = min(d[i, label == c].mean() for c in set(label) - {label[i]})
            scores.append((b - a) / max(a, b) if own.sum() > 1 else 0)
        return np.mean(scores)

    square = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.isclose(segments.silhouettes(rows).first().silhouette, brute(square))


def test_segments_keep_conservation(daily):
    rng = np.random.default_rng(8)
    series = {("A", f"u{i}"): rng.normal(10 if i < 6 else 90, 1 + i % 3, 95) for i in range(12)}
    series |= {("S", "one"): rng.normal(10, 1, 95), ("A", "sparse"): [1, 2, 3]}
    found = segments.segments(daily(series)).collect()
    labels = {r.equipment_id: r.cluster_label for r in found}
    assert len(found) == 14 and labels["sparse"] == "INSUFFICIENT_DATA"
    assert {r.cluster_id for r in found if r.equipment_category == "S"} == {-1}


def test_two_months_have_no_growth(daily):
    got = segments.unit_profiles(daily({("A", "u"): [1.0] * 50})).first()
    assert got.monthly_growth is None and got.active_day_ratio == 1.0


def test_trees_by_levels_walk_as_their_nodes(spark):
    draw = np.random.default_rng(2)
    for n in (2, 3, 40, 256):
        tree = isolation._grow(np.round(draw.normal(size=(n, 4)), 1), draw)
        asked = np.round(draw.normal(size=(300, 4)), 1)
        asked[::9, 2] = np.nan
        want = []
        for row in asked:
            node, depth = 0, 0
            while tree["feature"][node] >= 0:
                node, depth = 2 * node + 1 + int(row[tree["feature"][node]] > tree["cut"][node]), depth + 1
            want.append(depth + isolation._path_left([tree["size"][node]])[0])
        got = isolation._depths(asked, *isolation._leveled(tree["feature"], tree["cut"], tree["size"]))
        assert got.tolist() == want


def test_points_of_trees_are_drawn_beside_the_rows(spark):
    rows = spark.createDataFrame([("a", f"u{i % 7}", dt.date(2020, 1, 1) + dt.timedelta(days=i // 7), float(i), 0.0, 1, 2)
                                  for i in range(3000)], "equipment_category string, equipment_id string, date date, "
                                 "fuel_liter double, deviation_from_category_median double, day_of_week int, month_num int")
    sizes = spark.createDataFrame([("a", 3000)], "equipment_category string, n_rows long")
    points = isolation.drawn_points(rows, sizes)
    assert "Generate" not in points._jdf.queryExecution().executedPlan().toString()
    cfg = isolation.DEFAULT
    factors = np.random.default_rng(cfg.seed).integers(1, isolation.PLACES, size=(cfg.forest_trees, 2)).tolist()
    base = [r[0] for r in rows.select(F.expr(f"pmod(xxhash64(equipment_category, equipment_id, date), {isolation.PLACES})")).collect()]
    last = math.ceil(min((cfg.forest_sample + 10 * cfg.forest_sample ** 0.5) / 3000, 1.0) * isolation.PLACES)
    want = sorted((t, p) for t, (a, b) in enumerate(factors) for x in base for p in [(x * a + b) % isolation.PLACES] if p < last)
    assert sorted((r.tree, r.place) for r in points.select("tree", "place").collect()) == want


def test_units_across_batches_are_segmented_whole(spark):
    draw = np.random.default_rng(3)
    series = {unit: np.concatenate([draw.normal(10, 1, 40), draw.normal(50 + 5 * i, 1, 35)])
              for i, unit in enumerate(("a", "b", None, "d"))}
    rows = spark.createDataFrame([("c" if unit != "d" else None, unit, at, dt.date(2020, 1, 1) + dt.timedelta(days=at), float(v), len(values))
                                  for unit, values in series.items() for at, v in enumerate(values)],
                                 "equipment_category string, equipment_id string, position int, date date, fuel_liter double, n_observations int")
    cfg = changepoint.DEFAULT
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        plan = changepoint.kernel_changes(rows)
        got = {}
        for r in plan.where("is_change").collect():
            got.setdefault(r.equipment_id, []).append(r.position)
        assert plan.count() == 300
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {u: sorted(v) for u, v in got.items()} == {
        u: changepoint.kernel_breaks(v, cfg.change_penalty, cfg.change_min_size, cfg.change_jump) for u, v in series.items()}


def test_median_gap_begins_near_its_end(monkeypatch):
    draw = np.random.default_rng(4)
    for values in (draw.normal(size=50), draw.integers(1, 9, 61).astype(float), np.full(9, 0.1), np.array([2.5, 1.5]), draw.random(130) * 1e-7):
        monkeypatch.setattr(changepoint, "PAIRED", 1024)
        near = changepoint.typical_gap(values)
        monkeypatch.setattr(changepoint, "PAIRED", 0)
        assert near == changepoint.typical_gap(values)


def test_filters_on_severity_do_not_sort_windows_again(spark, daily):
    rows = anomaly.anomaly_report(daily({("A", "u"): range(1, 40)}), use_forest=False)
    found = rows.where("severity != 'INSUFFICIENT_DATA'").where("severity != 'NORMAL'").select("severity")
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("sort_array") <= 2
    assert not [line for line in text.splitlines() if "Filter" in line and "sort_array" in line]
