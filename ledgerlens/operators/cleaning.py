"""Flag every ledger row; never drop one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens.config import DEFAULT, LedgerConfig
from ledgerlens.functions.calc import lookup
from ledgerlens.functions.ranks import group_quantiles
from ledgerlens.functions.text import match_key, unit_name
from ledgerlens.schema import AMOUNT, CATEGORY, DATE, LEDGER_COLUMNS, UNIT, UNIT_KEY
from ledgerlens.scratch import join_measured

ANALYSED = ("VALID", "UNUSUALLY_HIGH")


def dated(cleaned: DataFrame) -> DataFrame:
    """Rows that count in totals."""
    return cleaned.where(F.col("data_status") != "INVALID_DATE")


def analysed(cleaned: DataFrame) -> DataFrame:
    """Rows that models read: at most one per unit and day, so a unit is bounded by the calendar."""
    return cleaned.where(F.col("data_status").isin(*ANALYSED))


def high_limits(ledger: DataFrame, cfg: LedgerConfig = DEFAULT) -> DataFrame:
    """Upper limit per category, Q3 + multiplier * IQR, for categories with enough dated amounts."""
    quartiles = group_quantiles(ledger.where(F.col(DATE).isNotNull()), [CATEGORY], AMOUNT,
                                {"q1": 0.25, "q3": 0.75}, n="n_values")
    limit = F.col("q3") + cfg.iqr_multiplier * (F.col("q3") - F.col("q1"))
    return (quartiles.where(F.col("n_values") >= cfg.iqr_min_values)
            .select(CATEGORY, "q1", "q3", "n_values", limit.alias("high_limit")))


def repeated_keys(ledger: DataFrame) -> DataFrame:
    """Dated (date, category, unit) combinations that occur more than once.

    Counted with partial sums and joined back, instead of a window over all copies of a key: a key
    that fills a third of the ledger is then one counted row, and its copies stay spread out.
    """
    return (ledger.where(F.col(DATE).isNotNull()).groupBy(DATE, *UNIT_KEY)
            .agg(F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1"))


def row_status(amount: Column, status_text: Column, date: Column, repeated: Column, high: Column,
               known: tuple[str, ...]) -> Column:
    """Status of a row; the first condition that holds decides."""
    return (F.when(date.isNull(), "INVALID_DATE")
            .when(amount < 0, "NEGATIVE_VALUE")
            .when(repeated, "DUPLICATE")
            .when(high, "UNUSUALLY_HIGH")
            .when(status_text.isNotNull() & ~status_text.isin(*known), "UNKNOWN_STATUS")
            .when(amount.isNull() & status_text.isNotNull(), "STATUS_ONLY")
            .when(amount.isNull(), "MISSING")
            .otherwise("VALID"))


def standardised(ledger: DataFrame) -> DataFrame:
    """Ledger with single-spaced ids without alias, and without NaN amounts."""
    return ledger.withColumns({UNIT: unit_name(F.col(UNIT)), AMOUNT: F.nanvl(F.col(AMOUNT), F.lit(None))})


def clean(ledger: DataFrame, cfg: LedgerConfig = DEFAULT, limits: DataFrame | None = None) -> DataFrame:
    """Cleaned ledger: all rows with data_status and issue_code.

    `limits` takes published category limits in place of those of this ledger.
    """
    rows = standardised(ledger)
    limits = high_limits(rows, cfg) if limits is None else limits
    repeated = repeated_keys(rows)
    # A missing unit or category is a key like any other; else its rows would have no bound per day.
    same = [rows[c].eqNullSafe(repeated[c]) for c in (DATE, *UNIT_KEY)]
    rows = rows.join(repeated, same, "left").select(rows["*"], "n_copies")
    rows = join_measured(rows, limits.select(CATEGORY, "high_limit"), CATEGORY)
    status = row_status(F.col(AMOUNT), F.col("status_text"), F.col(DATE), F.col("n_copies").isNotNull(),
                        F.col(AMOUNT) > F.col("high_limit"), cfg.known_statuses)
    return (rows.withColumn("data_status", status)
            .withColumn("issue_code", lookup(F.col("data_status"), fv.ISSUE_CODES))
            .select(*LEDGER_COLUMNS, "data_status", "issue_code"))


def variant_members(cleaned: DataFrame) -> DataFrame:
    """Every spelling of an id that shares its match key with another spelling, one row each."""
    units = dated(cleaned).select(*UNIT_KEY).distinct().withColumn("match_key", match_key(F.col(UNIT)))
    sizes = units.groupBy(CATEGORY, "match_key").agg(F.count(F.lit(1)).alias("n_spellings"))
    return units.join(sizes.where("n_spellings > 1"), [CATEGORY, "match_key"])


def unit_master(cleaned: DataFrame) -> DataFrame:
    """One row per unit: first and last day, record counts, how many other spellings its id has.

    `variant_members` lists the spellings, one row each.
    """
    units = dated(cleaned).groupBy(*UNIT_KEY).agg(
        F.min(DATE).alias("first_seen_date"), F.max(DATE).alias("last_seen_date"),
        F.count(DATE).alias("n_records"), F.count(AMOUNT).alias("n_valid_liter_records"))
    others = variant_members(cleaned).select(*UNIT_KEY, (F.col("n_spellings") - 1).alias("n_variants"))
    return (units.join(others, UNIT_KEY, "left").withColumn("n_variants", F.coalesce("n_variants", F.lit(0)))
            .select(*UNIT_KEY, "first_seen_date", "last_seen_date", "n_records", "n_valid_liter_records", "n_variants",
                    (F.col("n_variants") > 0).alias("has_possible_variant"),
                    (F.month("first_seen_date") > 1).alias("is_new_after_january")))


def issue_report(cleaned: DataFrame) -> DataFrame:
    """Per issue: occurrences, units, the first example in ledger order, description."""
    place = F.struct(CATEGORY, UNIT, DATE, "source_file", "source_row")

    def first(column: str) -> Column:
        return F.min_by(column, place).alias(f"example_{column}")

    return (cleaned.where((F.col("data_status") != "VALID") & F.col("issue_code").isNotNull())
            .groupBy("issue_code", "data_status")
            .agg(F.count(UNIT).alias("n_occurrences"), F.count_distinct(UNIT).alias("n_equipment_affected"),
                 first(UNIT), first("source_sheet"), first("source_row"))
            .withColumn("description", lookup(F.col("issue_code"), fv.ISSUE_TEXTS, ""))
            .orderBy(F.desc("n_occurrences"), "issue_code"))
