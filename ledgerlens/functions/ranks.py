"""Exact ranks and quantiles within groups that may hold most of the rows.

A sort of one group, or one map of all its values, would land in a single task. Instead equal values
are counted first (spread over group and value). Then the counts are summed by prefixes of the value's
ordered bits and accumulated level by level: the prefixes of one level below one prefix of the level
above, at most 2^18 rows a window whatever the data. The doubles of a full prefix, at most 4,096, are
ordered last. Quantiles follow only the prefixes that hold a wanted rank. The prefix is a fixed rising
function of the value, so nothing depends on sampling or on a second evaluation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# Bits of the key below the three prefixes. A prefix has at most 2^18 followers; the doubles that share the
# whole key differ in their last 12 bits only.
SHIFTS = {"_p1": 36, "_p2": 18, "_p3": 0}


def _keyed(df: DataFrame, value: str) -> DataFrame:
    """Adds _key, a long that rises with the value: sign, exponent and the first 40 bits of the fraction.

    Step by step, so that no step's expression is written out again in the next one.
    """
    size, two = F.col("_size"), F.lit(2.0)
    df = df.withColumn("_size", F.abs(F.col(value).cast("double")))
    df = df.withColumn("_guess", F.floor(F.log2(F.nullif(size, F.lit(0.0)))).cast("int"))
    df = df.withColumn("_near", size / F.pow(two, F.col("_guess")))
    df = df.withColumn("_exponent", F.col("_guess") + F.when(F.col("_near") >= 2, 1).when(F.col("_near") < 1, -1).otherwise(0))
    fraction = F.floor((size / F.pow(two, F.col("_exponent")) - 1) * float(1 << 40))
    df = df.withColumn("_key", (F.col("_exponent") + 1075) * F.lit(1 << 40) + fraction)
    df = df.withColumn("_key", F.when(size == float("inf"), F.lit(1 << 52)).otherwise(F.coalesce("_key", F.lit(0))))
    df = df.withColumn("_key", F.when(F.col(value) < 0, -F.col("_key")).otherwise(F.col("_key")).cast("long"))
    return df.drop("_size", "_guess", "_near", "_exponent")


def _counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    present = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    counted = _keyed(present.groupBy(*keys, F.col(value)).agg(F.count(F.lit(1)).alias("_ties")), value)
    return counted.withColumns({name: F.shiftright("_key", bits) for name, bits in SHIFTS.items()}).drop("_key")


def _levels(counted: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """Per prefix, from short to long, the number of its values."""
    out, rows = [], counted.withColumnRenamed("_ties", "_held")
    for depth in (3, 2, 1):
        rows = rows.groupBy(*keys, *[f"_p{i}" for i in range(1, depth + 1)]).agg(F.sum("_held").alias("_held"))
        out.insert(0, rows)
    return out


def _placed(counted: DataFrame, keys: Sequence[str], value: str, hit=None) -> DataFrame:
    """Distinct values with the number of smaller ones; `hit(base, held, n)` tells which prefixes are followed.

    A level is cut to the prefixes that are followed before its window, so that only what lies below them is sorted.
    """
    base = None
    for depth, level in enumerate(_levels(counted, keys), 1):
        path = [f"_p{i}" for i in range(1, depth + 1)]
        before = Window.partitionBy(*keys, *path[:-1]).orderBy(path[-1]).rowsBetween(Window.unboundedPreceding, -1)
        below = F.coalesce(F.sum("_held").over(before), F.lit(0))
        if base is None:
            level = level.withColumns({"_below": below, "_n": F.sum("_held").over(Window.partitionBy(*keys))})
        else:
            level = level.join(base, [*keys, *path[:-1]]).withColumn("_below", below + F.col("_base")).drop("_base")
        if hit is not None:
            level = level.where(hit(F.col("_below"), F.col("_held"), F.col("_n")))
        base = level.withColumnRenamed("_below", "_base").drop("_held")
    leaf = Window.partitionBy(*keys, *SHIFTS).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (counted.join(base, [*keys, *SHIFTS])
            .withColumn("_before", F.col("_base") + F.coalesce(F.sum("_ties").over(leaf), F.lit(0))))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per group and distinct value: smaller values (_before), equal ones (_ties), all (_n)."""
    counted = _counted(df, keys, value)
    return (_placed(counted, keys, value)
            .select(*keys, value, "_before", "_ties", "_n"))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    wanted: Mapping[str, float], n: str | None = None) -> DataFrame:
    """Interpolated quantiles per group (name -> probability), and the count of values if `n` is named."""
    counted = _counted(df, keys, value)
    spots = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in wanted.items()}

    def hit(base: Column, held: Column, n: Column) -> Column:
        ends = [end((n - 1) * F.lit(float(p))) for p in wanted.values() for end in (F.floor, F.ceil)]
        return reduce(lambda a, b: a | b, [(base <= end) & (end < base + held) for end in ends])

    placed = _placed(counted, keys, value, hit)

    def at(end: Column) -> Column:
        here = (F.col("_before") <= end) & (end < F.col("_before") + F.col("_ties"))
        return F.max(F.when(here, F.col(value)))

    columns = []
    for name, spot in spots.items():
        low, high = at(F.floor(spot)), at(F.ceil(spot))
        columns.append((low + (high - low) * F.max(spot - F.floor(spot))).alias(name))
    if n is not None:
        columns.append(F.max("_n").alias(n))
    return placed.groupBy(*keys).agg(*columns)


def percent_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank of each distinct value over the number of values in its group, in (0, 1]."""
    rank = (F.col("_before") + (F.col("_ties") + 1) / 2) / F.col("_n")
    return value_ranks(df, keys, value).select(*keys, value, rank.alias(name))
