"""Lasting changes in a unit's consumption."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.operators.cleaning import analysed
from ledgerlens.schema import AMOUNT, CATEGORY, DATE, ROW_ORDER, UNIT_KEY
from ledgerlens.scratch import spread

SIDE = 7
# Differences of all pairs are laid out for up to so many values, to begin the search for their median near its end.
PAIRED = 1024


def unit_series(cleaned: DataFrame) -> DataFrame:
    """Analysed rows with their position in the unit's series and its length."""
    rows = analysed(cleaned).select(*UNIT_KEY, *ROW_ORDER, AMOUNT)
    unit = Window.partitionBy(*UNIT_KEY)
    return rows.withColumns({
        "position": F.row_number().over(unit.orderBy(*ROW_ORDER)) - 1,
        "n_observations": F.count(F.lit(1)).over(unit),
    })


def _shift_columns() -> dict[str, Column]:
    """Means on both sides of each position, their joint spread, and whether the step exceeds it."""
    order = Window.partitionBy(*UNIT_KEY).orderBy("position")
    before, after, both = (order.rowsBetween(a, b) for a, b in ((-SIDE, -1), (0, SIDE - 1), (-SIDE, SIDE - 1)))
    enough = (F.count(AMOUNT).over(before) >= 2) & (F.count(AMOUNT).over(after) >= 2)
    step = F.abs(F.avg(AMOUNT).over(after) - F.avg(AMOUNT).over(before))
    spread = F.stddev_pop(AMOUNT).over(both)
    ratio = F.when(enough, F.try_divide(step, spread))
    return {"shift_ratio": ratio, "confirmed": F.coalesce(ratio >= 1, F.lit(False))}


def mean_shift_scan(series: DataFrame, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Positions where the shift is confirmed and largest within the minimum segment length.

    Runs on window frames only and so serves long ledgers; of equal shifts the first is kept.
    """
    near = cfg.change_min_size - 1
    order = Window.partitionBy(*UNIT_KEY).orderBy("position")
    ratio = F.col("shift_ratio")
    peak = ((ratio > F.coalesce(F.max("shift_ratio").over(order.rowsBetween(-near, -1)), F.lit(-1.0)))
            & (ratio >= F.coalesce(F.max("shift_ratio").over(order.rowsBetween(1, near)), F.lit(-1.0))))
    inside = ((F.col("position") >= cfg.change_min_size)
              & (F.col("position") <= F.col("n_observations") - cfg.change_min_size))
    return (series.where(F.col("n_observations") >= cfg.change_min_observations)
            .withColumns(_shift_columns())
            .withColumn("shift_ratio", F.when(inside, ratio))
            .withColumn("is_change", F.coalesce(peak & F.col("confirmed"), F.lit(False))))


def _gap_of_rank(ordered: np.ndarray, rank: int, guess: float | None = None) -> float:
    """The difference of two of the ordered values that `rank` other pairs do not exceed, in memory of their number.

    Non-negative doubles are ordered as their bits are, so the search halves the range of bits, which begins around a guess.
    """
    below = np.arange(1, len(ordered) + 1)
    low, high = -1, int(np.float64(ordered[-1] - ordered[0]).view(np.int64))

    def holds(bits):
        return (np.searchsorted(ordered, ordered + np.int64(bits).view(np.float64), side="right") - below).sum() > rank

    at, step = high if guess is None else int(np.float64(guess).view(np.int64)), 1
    if guess is not None and holds(at):
        high = min(high, at)
        while high - step > low and holds(high - step):
            high, step = high - step, step * 2
        low = max(low, high - step)
    elif guess is not None:
        low = at
        while low + step < high and not holds(low + step):
            low, step = low + step, step * 2
        high = min(high, low + step)
    while high - low > 1:
        middle = (low + high) // 2
        if holds(middle):
            high = middle
        else:
            low = middle
    return float(np.int64(high).view(np.float64))


def typical_gap(values: np.ndarray) -> float:
    """Median of the squared differences of all pairs."""
    ordered, pairs = np.sort(values), len(values) * (len(values) - 1) // 2
    if not pairs:
        return 0.0
    ranks, guesses = sorted({(pairs - 1) // 2, pairs // 2}), {}
    if len(values) <= PAIRED:
        gaps = np.concatenate([ordered[i:] - ordered[:-i] for i in range(1, len(ordered))])
        gaps.partition(ranks)
        guesses = {rank: gaps[rank] for rank in ranks}
    found = {rank: _gap_of_rank(ordered, rank, guesses.get(rank)) ** 2 for rank in ranks}
    return (found[ranks[0]] + found[ranks[-1]]) / 2


def kernel_breaks(values: np.ndarray, penalty: float, min_size: int, jump: int) -> list[int]:
    """Starts of new segments that minimise kernel cost plus a penalty per segment.

    Penalised segmentation with the Gaussian kernel cost (Arlot, Celisse & Harchaoui 2019), bandwidth by the median heuristic,
    over positions that are multiples of `jump`. A start that is dearer up to some end than a break at that end stays so
    for all later ends that allow both (Killick, Fearnhead & Eckley 2012); it is left out from there on. For each start that is left
    the sum of the kernel over its segment grows with the end, so memory is linear in the series.
    """
    n, typical = len(values), typical_gap(values)
    grid = np.append(np.arange(0, n, jump), n)
    best, came = np.full(len(grid), np.inf), np.zeros(len(grid), dtype=int)
    best[0] = 0.0
    starts, within, gone = np.empty(0, int), np.empty(0), np.empty(0, int)
    for end in range(1, len(grid)):
        if np.isfinite(best[end - 1]):
            starts, within, gone = np.append(starts, end - 1), np.append(within, 0.0), np.append(gone, n + 1)
        left = gone > grid[end]
        starts, within, gone = starts[left], within[left], gone[left]
        new, first = values[grid[end - 1]:grid[end]], grid[starts[0]]
        apart = (values[first:grid[end], None] - new[None, :]) ** 2
        alike = np.exp(-np.clip(apart / typical if typical else apart, 1e-2, 1e2))
        np.fill_diagonal(alike[-len(new):], 1.0)
        onward = np.append(np.cumsum(alike.sum(axis=1)[::-1])[::-1], 0.0)
        within += 2 * onward[grid[starts] - first] - onward[grid[end - 1] - first]
        length = grid[end] - grid[starts]
        fits = np.flatnonzero(length >= min_size)
        if not len(fits):
            continue
        so_far = best[starts[fits]] + length[fits] - within[fits] / length[fits]
        came[end], best[end] = starts[fits[np.argmin(so_far)]], so_far.min() + penalty
        dear = fits[so_far > best[end] + 1e-9]
        gone[dear] = np.minimum(gone[dear], grid[end] + min_size)
    breaks, at = [], len(grid) - 1
    while at > 0 and np.isfinite(best[-1]):
        at = came[at]
        if at > 0:
            breaks.append(int(grid[at]))
    return breaks[::-1]


def kernel_changes(series: DataFrame, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Series with is_change from the kernel segmentation; the rows of a unit lie side by side in one task.

    A unit's series is bounded by the number of days in the calendar (one analysed row per day).
    """
    penalty, size, jump = cfg.change_penalty, cfg.change_min_size, cfg.change_jump

    def marked(rows: pa.Table, begins: list[int]):
        amounts, places = (rows.column(c).to_numpy() for c in (AMOUNT, "position"))
        found = np.zeros(len(rows), bool)
        for lo, hi in zip(begins, [*begins[1:], len(rows)]):
            breaks = kernel_breaks(amounts[lo:hi].astype(float), penalty, size, jump)
            found[lo:hi] = np.isin(places[lo:hi], breaks)
        yield from rows.append_column("is_change", pa.array(found)).to_batches()

    def segment(batches):
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if held is None else pa.concat_tables([held, rows])
            keys = [*zip(*(rows.column(c).to_pylist() for c in UNIT_KEY))]
            begins = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            # The last unit may go on in the next batch.
            if len(begins) > 1:
                yield from marked(rows.slice(0, begins[-1]), begins[:-1])
            held = rows.slice(begins[-1]) if begins else None
        if held is not None:
            yield from marked(held, [0])

    rows = series.where(F.col("n_observations") >= cfg.change_min_observations)
    found = spread(rows.select(*UNIT_KEY, "position", DATE, AMOUNT), *UNIT_KEY).sortWithinPartitions(*UNIT_KEY, "position").mapInArrow(
        segment, f"{CATEGORY} string, equipment_id string, position int, {DATE} date, {AMOUNT} double, "
                 "is_change boolean")
    return found.withColumns(_shift_columns())


def change_direction(before_mean: Column, after_mean: Column, before_std: Column, after_std: Column) -> Column:
    """A level change of at least 15 %, else a change of spread of at least 30 %, else a minor shift."""
    level = F.abs(after_mean - before_mean) / F.nullif(before_mean, F.lit(0.0)) * 100
    spread = F.abs(after_std - before_std) / F.nullif(before_std, F.lit(0.0)) * 100
    return (F.when((level >= 15) | (before_mean == 0),
                   F.when(after_mean > before_mean, "INCREASE").otherwise("DECREASE"))
            .when((spread >= 30) | (before_std == 0),
                  F.when(after_std > before_std, "VOLATILITY_INCREASE").otherwise("VOLATILITY_DECREASE"))
            .otherwise("MINOR_SHIFT"))


def change_confidence(level_pct: Column, confirmed: Column, n_before: Column, n_after: Column) -> Column:
    """HIGH for a large confirmed change, MEDIUM for either a clear or a confirmed one, else LOW."""
    level = F.coalesce(level_pct, F.lit(0.0))
    return (F.when((n_before < 5) | (n_after < 5), "LOW")
            .when((level >= 40) & confirmed, "HIGH")
            .when((level >= 15) | confirmed, "MEDIUM").otherwise("LOW"))


def segment_changes(marked: DataFrame) -> DataFrame:
    """One row per change: the segments on both sides, size, direction, confidence.

    `marked` holds the rows of a unit by position with is_change and confirmed.
    """
    order = Window.partitionBy(*UNIT_KEY).orderBy("position")
    numbered = marked.withColumn("segment", F.sum(F.col("is_change").cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    segments = numbered.groupBy(*UNIT_KEY, "segment").agg(
        F.avg(AMOUNT).alias("mean"), F.stddev_pop(AMOUNT).alias("std"), F.count(F.lit(1)).alias("n"),
        F.min(F.struct("position", DATE, "confirmed")).alias("start"))
    by_segment = Window.partitionBy(*UNIT_KEY).orderBy("segment")
    pairs = segments.select("*", *[F.lag(c).over(by_segment).alias(f"before_{c}") for c in ("mean", "std", "n")])
    before, after = F.col("before_mean"), F.col("mean")
    level = F.abs(after - before) / F.nullif(before, F.lit(0.0)) * 100
    return (pairs.where("segment > 0 AND n >= 2 AND before_n >= 2")
            .select(*UNIT_KEY, F.col(f"start.{DATE}").alias("change_date"),
                    F.round(before, 1).alias("before_mean"), F.round(after, 1).alias("after_mean"),
                    F.round("before_std", 1).alias("before_std"), F.round("std", 1).alias("after_std"),
                    F.round(after - before, 1).alias("absolute_change"),
                    F.round(level, 1).alias("percentage_change"),
                    change_direction(before, after, F.col("before_std"), F.col("std")).alias("change_direction"),
                    change_confidence(level, F.col("start.confirmed"), F.col("before_n"), F.col("n"))
                    .alias("confidence"),
                    F.col("before_n").alias("n_obs_before"), F.col("n").alias("n_obs_after")))


def change_points(cleaned: DataFrame, cfg: LedgerConfig = DEFAULT, method: str = "kernel") -> DataFrame:
    """Change report of all units with enough observations; method "kernel" or "mean_shift"."""
    marked = {"kernel": kernel_changes, "mean_shift": mean_shift_scan}[method](unit_series(cleaned), cfg)
    return segment_changes(marked).select(
        "equipment_id", CATEGORY, "change_date", "before_mean", "after_mean", "absolute_change",
        "percentage_change", "change_direction", "confidence", F.lit("PENDING_REVIEW").alias("review_status"))


def skipped_units(cleaned: DataFrame, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Number of units with too few observations for change detection."""
    sizes = analysed(cleaned).groupBy(*UNIT_KEY).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count_if(F.col("n") < cfg.change_min_observations).alias("n_skipped"))


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy(CATEGORY, "change_direction").agg(F.count(F.lit(1)).alias("n_change_points"))
