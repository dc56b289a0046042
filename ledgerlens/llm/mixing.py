"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source has a weight. The budget is shared by weight; a source stops at `EPOCHS` times its size, and what it
cannot take is shared anew by weight among the rest until none is above. A source with target T and size S takes all
its documents floor(T / S) times, and one time more the documents that come first by a seeded hash, until the target is
met; the document on the border is taken in part (`partial`), or whole if half of it or more is due.

The border is found by sums over ever finer ranges of the hash, so no source is ordered in one task, whatever its size.

Defined results: a null text has size 0; a null source is a source of its own and the last; rows with the same doc_id
share their hash and are taken alike; a source of size 0 has target 0; an empty table gives no rows; other columns are
not read (`mix` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2.0
SEED = 7
# Hex digits of the hash that each pass refines, and passes before the rest is ordered.
DIGITS, PASSES = 2, 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """Where a document stands in its source's order."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) by capped water-filling; works on one row per source."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(one)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((at - 1) % len(weights) + 1).cast("int"))
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    cap = F.col("source_size") * epochs
    # In ascending order of cap / weight the sources fill up one after the other.
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The level that holds if exactly the sources before this one are full; it is the right one for the first source
    # that it does not fill, and falls from there on.
    filled = (total.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
              .withColumn("budget", F.sum("source_size").over(whole) * share)
              .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                          / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    return (filled.withColumn("level", level)
            .select("source", "source_size", "weight",
                    F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap"))
                    .otherwise(F.col("level") * F.col("weight")).alias("target")))


def borders(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: whole repetitions, and the document at which the last, fractional one ends.

    `due` is what the border document still owes of the `tied` words at its place.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = (goals.withColumn("times", times.cast("long"))
             .withColumn("due", F.floor(F.col("target")).cast("long") - F.col("times") * F.col("source_size"))
             .withColumn("prefix", F.lit("")))
    found = state.select("source", "due", "prefix").where("due > 0")
    sizes = sizes.where("size > 0").select("source", "size", "place")
    for step in range(PASSES + 1):
        last = step == PASSES
        key = F.col("place") if last else F.substring("place", 1, DIGITS * (step + 1))
        in_reach = sizes.join(
            found.withColumnRenamed("source", "s"),
            F.col("source").eqNullSafe(F.col("s")) & F.col("place").startswith(F.col("prefix")))
        ranges = (in_reach.withColumn("key", key).groupBy("source", "due", "key").agg(F.sum("size").alias("tied")))
        order = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
        found = stored(ranges.withColumn("upto", F.sum("tied").over(order))
                       .where("upto >= due and upto - tied < due")
                       .select("source", (F.col("due") - F.col("upto") + F.col("tied")).alias("due"),
                               F.col("key").alias("prefix"), "tied"), "border").drop(*([] if last else ["tied"]))
    ends = found.select(F.col("source").alias("s"), F.col("due").alias("rest"), F.col("prefix").alias("border"), "tied")
    return (state.drop("prefix", "due").join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def repeated(sized: DataFrame, ends: DataFrame, partial: bool) -> DataFrame:
    """Adds per document: times it is taken whole, and words of one more, partial time."""
    ends = ends.withColumnRenamed("source", "s")  # one row per source, stored: Spark broadcasts it if its size allows
    border = F.col("place") == F.col("border")
    cut = F.floor(F.col("size") * F.col("rest") / F.col("tied"))
    part = F.when(border & (F.col("size") > 0), cut).otherwise(0) if partial else F.lit(0)
    extra = F.col("place") < F.col("border")
    if not partial:
        extra = extra | border & (2 * F.col("rest") >= F.col("tied"))
    return (sized.join(ends, F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumn("copies", F.col("times") + F.coalesce(extra, F.lit(False)).cast("long"))
            .withColumn("part", F.coalesce(part, F.lit(0)).cast("long")))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes of all documents, read once, and the ends of all sources."""
    sizes = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"),
                               place(F.col("doc_id")).alias("place")), "sizes")
    return sizes, stored(borders(sizes, stored(targets(sizes), "targets")), "ends")


def shares(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document."""
    sizes, ends = plan(docs)
    return repeated(sizes, ends, partial=True).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"),
        (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), "source", "copies", "part")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents, whole texts only, each as often as it is taken; all columns are kept."""
    _, ends = plan(docs)
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    sized = docs.select(own.alias("own"), "doc_id", "source", size_of(F.col("text")).alias("size"),
                        place(F.col("doc_id")).alias("place"))
    # One row more for each time, made only where the document is taken.
    return (repeated(sized, ends, partial=False).where("copies > 0")
            .select("own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("own.*"))
