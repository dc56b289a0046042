"""Text expressions for ids, unit strings, sheet names and cells."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import fixed_values as fv
from ledgerlens.functions.calc import lookup

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def one_spaced(text: Column) -> Column:
    """Single blanks between words, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unit_name(raw: Column) -> Column:
    """Id without the alias after a slash, single-spaced."""
    return one_spaced(F.split_part(raw, F.lit("/"), F.lit(1)))


def match_key(unit: Column) -> Column:
    """Loose key that equal ids share however they are punctuated."""
    return F.upper(F.regexp_replace(F.split_part(unit, F.lit("/"), F.lit(1)), "[^A-Za-z0-9]", ""))


def split_unit(raw: Column, prefixes: Mapping[str, str] = fv.UNIT_PREFIXES) -> tuple[Column, Column]:
    """(category, id) of a vendor unit string such as "HT 136"."""
    pattern = r"^([A-Za-z]+)\s*(.+)"
    text = F.trim(raw)
    prefix = F.upper(F.regexp_extract(text, pattern, 1))
    split = prefix != ""
    category = F.when(split, F.coalesce(lookup(prefix, prefixes), prefix)).otherwise(text)
    return category, F.when(split, F.trim(F.regexp_extract(text, pattern, 2))).otherwise(text)


def sheet_month(sheet: Column, months: Mapping[str, int] = fv.SHEET_MONTHS) -> Column:
    """Month number named by the first word of a sheet name, else missing."""
    first = F.split_part(one_spaced(F.upper(sheet)), F.lit(" "), F.lit(1))
    return lookup(first, months)


def sheet_year(sheet: Column) -> Column:
    """First four-digit year in a sheet name, else missing."""
    return F.nullif(F.regexp_extract(sheet, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def number_in(text: Column) -> Column:
    """The number a text spells, else missing."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def cell_value(text: Column, known: Iterable[str] = fv.STATUS_TOKENS) -> tuple[Column, Column]:
    """(amount, status) of one cell: a number, a known word, an unknown word, or nothing."""
    shown = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    word = F.upper(one_spaced(text))
    amount = F.when(~word.isin(*known), number_in(F.replace(shown, F.lit(","), F.lit("."))))
    status = F.when((word != "") & amount.isNull(), word)
    return amount, status


def date_from(year: Column, month: Column, day: Column) -> Column:
    """Date of the parts, missing for impossible days such as 30 February."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
