"""Price columns: the ways in which price text is normalised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

# The texts around a price in a shop's sale notice.
CURRENT_PRICE_MARK = "El precio actual es:"
ORIGINAL_PRICE_MARK = "El precio original era:"

# try_cast takes "7d" and "NaN" as numbers, so the text is checked first.
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"


def _plain(c: Column) -> Column:
    """Without the euro sign and with a decimal point, as both formats below start."""
    return strip(F.replace(F.replace(c, F.lit("€"), F.lit("")), F.lit(","), F.lit(".")))


def _decimal(c: Column) -> Column:
    """A number with two decimals, rounded once from the whole text; NULL when the text is no number
    or has more than 36 digits before the point."""
    return let(c, lambda v: F.when(v.rlike(_NUMBER), v.try_cast("decimal(38,2)")))


def price_amount(c: Column) -> Column:
    """Typed amount. Unlike the text formats, it reads a point before a comma as thousands."""

    def number(bare: Column) -> Column:
        thousands = bare.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]+$")
        digits = F.when(thousands, F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)
        return F.replace(digits, F.lit(","), F.lit("."))

    return _decimal(let(strip(F.replace(c, F.lit("€"), F.lit(""))), number))


def price_eur(c: Column) -> Column:
    """``12,5 €`` becomes ``12.50€``; text that is no number stays as it is."""
    return F.coalesce(F.concat(_decimal(_plain(c)).cast("string"), F.lit("€")), c)


def price_current(c: Column) -> Column:
    """The price after the last "current price" mark, else the text before the "original" mark."""
    marked = F.element_at(F.split(c, CURRENT_PRICE_MARK), -1)
    unmarked = F.element_at(F.split(c, ORIGINAL_PRICE_MARK), 1)
    chosen = F.when(c.contains(CURRENT_PRICE_MARK), marked).otherwise(unmarked)
    grouped = F.format_number(_decimal(_plain(chosen)), 2)
    return F.coalesce(F.concat(F.replace(grouped, F.lit("."), F.lit(",")), F.lit("€")), c)


def price_last(c: Column) -> Column:
    """The last ``d,dd€`` in the text; text without one stays as it is."""
    found = F.regexp_extract_all(c, F.lit(r"([0-9]+,[0-9]{2}€)"), F.lit(1))
    return F.coalesce(F.when(F.size(found) > 0, F.element_at(found, -1)), c)
