import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.schema import LEDGER, LEDGER_COLUMNS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("ledger-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ledger(spark):
    """Builds a ledger from (date, category, unit, amount[, status]) tuples."""
    def build(rows):
        out = []
        for at, row in enumerate(rows):
            date, category, unit, amount, status = (*row, None)[:5]
            date = dt.date.fromisoformat(date) if isinstance(date, str) else date
            out.append((date, date.year if date else 2025, date.month if date else 2, category, unit,
                        None if amount is None else float(amount), status, "sheet", "file", at))
        return spark.createDataFrame(out, LEDGER)

    return build


@pytest.fixture(scope="session")
def daily(ledger):
    """A ledger of one unit with one amount per day, marked VALID."""
    from pyspark.sql import functions as F

    def build(series, start=dt.date(2024, 1, 1)):
        rows = [(start + dt.timedelta(days=i), category, unit, v)
                for (category, unit), values in series.items() for i, v in enumerate(values)]
        return ledger(rows).select(*LEDGER_COLUMNS, F.lit("VALID").alias("data_status"))

    return build
