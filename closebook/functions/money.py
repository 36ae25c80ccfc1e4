"""Money is a BIGINT of minor units; text becomes money exactly or not at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FX_TO_INR

EXACT = r"^[+-]?(\d+(\.\d{0,2}0*)?|\.\d{1,2}0*)$"


def plain(text: Column) -> Column:
    """Thousands separators and outer blanks removed; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(text, ",", "")), F.lit(""))


def to_minor(text: Column) -> Column:
    """Minor units of a major-unit text; null where it is no number or has more than two places.

    The precision is judged on the text: a cast to decimal would round silently.
    """
    return F.when(F.regexp_like(text, F.lit(EXACT)), (text.try_cast("decimal(30,6)") * 100).try_cast("bigint"))


def to_major(minor: Column) -> Column:
    return (minor.cast("decimal(20,2)") / 100).cast("decimal(20,2)")


def lakh_grouped(minor: Column) -> Column:
    """12345678 -> 1,23,456.78: the last three digits of the whole part, then pairs."""
    plain_text = F.format_string("%d.%02d", ((minor - minor % 100) / 100).cast("bigint"), minor % 100)
    return F.regexp_replace(plain_text, r"(\d)(?=(\d\d)*\d{3}\.)", "$1,")


def fx_rate(currency: Column) -> Column:
    """Rate to INR, null where none is known."""
    rates = F.create_map(*[x for k, v in FX_TO_INR.items() for x in (F.lit(k), F.lit(v).cast("decimal(10,4)"))])
    return F.try_element_at(rates, currency)


def fx_to_inr(minor: Column, currency: Column) -> Column:
    """Converted amount, rounded half to even."""
    return F.bround(minor.cast("decimal(20,0)") * fx_rate(currency), 0).cast("bigint")


def band(minor: Column, width: int = 10_000) -> Column:
    return ((minor - F.pmod(minor, F.lit(width))) / width).cast("bigint")
