"""Per-row features of a unit's own history.

All windows share one partitioning and one order, so Spark sorts once. A unit's analysed rows are at
most one per day, which bounds every partition by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.functions.calc import share
from ledgerlens.functions.ranks import group_quantiles
from ledgerlens.operators.cleaning import analysed
from ledgerlens.schema import AMOUNT, CATEGORY, DATE, ROW_ORDER, UNIT_KEY
from ledgerlens.scratch import join_measured


def history() -> WindowSpec:
    return Window.partitionBy(*UNIT_KEY).orderBy(*ROW_ORDER)


def _full(value: Column, n: int) -> Column:
    """A trailing statistic, given only when all n prior rows exist."""
    prior = history().rowsBetween(-n, -1)
    return F.when(F.count(AMOUNT).over(prior) == n, value.over(prior))


def _middle(values: Column, n: int) -> Column:
    """Median of an array of n values (n odd)."""
    return F.get(F.sort_array(values), F.lit(n // 2))


def category_medians(rows: DataFrame) -> DataFrame:
    return group_quantiles(rows, [CATEGORY], AMOUNT, {"category_median": 0.5})


def unit_features(cleaned: DataFrame, cfg: LedgerConfig = DEFAULT, medians: DataFrame | None = None) -> DataFrame:
    """Analysed rows with lags, changes, trailing and expanding statistics, peer and calendar features.

    `medians` takes published category medians in place of those of this ledger.
    """
    rows = analysed(cleaned)
    n = cfg.rolling_window
    earlier = history().rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("_last")
    out = rows.withColumns({
        "day_of_week": F.weekday(DATE),
        "month_num": F.month(DATE),
        "lag_1": F.lag(AMOUNT, 1).over(history()),
        "lag_7": F.lag(AMOUNT, 7).over(history()),
        "_last": _full(F.collect_list(AMOUNT), n),
        "rolling_mean_7": _full(F.avg(AMOUNT), n),
        "rolling_std_7": _full(F.stddev_pop(AMOUNT), n),
        "rolling_mean_14": _full(F.avg(AMOUNT), 14),
        "rolling_mean_30": _full(F.avg(AMOUNT), 30),
        "equipment_mean": F.when(F.count(AMOUNT).over(earlier) >= 2, F.avg(AMOUNT).over(earlier)),
    })
    out = out.withColumn("rolling_median_7", _middle(last, n))
    out = out.withColumn("rolling_mad_7", _middle(F.transform(last, lambda x: F.abs(x - F.col("rolling_median_7"))), n))
    # The count comes after the sorted arrays: a filter on what follows from both stops above its window, while it would
    # write the sorting out again at every place that reads the median or the MAD.
    out = out.withColumn("n_observations", F.count(AMOUNT).over(Window.partitionBy(*UNIT_KEY)))
    out = out.withColumns({
        "difference_1": F.col(AMOUNT) - F.col("lag_1"),
        "percentage_change": share(F.col(AMOUNT) - F.col("lag_1"), "lag_1"),
        "deviation_from_equipment_mean": F.col(AMOUNT) - F.col("equipment_mean"),
        "sufficient": F.col("n_observations") >= cfg.min_observations,
    }).drop("_last")
    out = join_measured(out, category_medians(rows) if medians is None else medians, CATEGORY)
    return out.withColumn("deviation_from_category_median", F.col(AMOUNT) - F.col("category_median"))
