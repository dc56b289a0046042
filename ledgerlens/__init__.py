"""Consumption-ledger analytics on Spark DataFrames."""

from ledgerlens.config import DEFAULT, LedgerConfig

__all__ = ["DEFAULT", "LedgerConfig"]
