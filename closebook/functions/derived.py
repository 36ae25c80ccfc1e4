"""Columns that follow from canonical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .money import to_major


def net_minor() -> Column:
    """Amount without fee and tax; absent ones are 0."""
    nothing = F.lit(0).cast("bigint")
    return F.col("amount_minor") - F.coalesce("fee_minor", nothing) - F.coalesce("tax_minor", nothing)


def dedupe_key() -> Column:
    """What a re-import is known by."""
    return F.struct("source", "external_ref")


def with_derived(rows: DataFrame) -> DataFrame:
    """Canonical rows with net_minor, amount_major (to be shown, never to be matched by) and dedupe_key."""
    return rows.withColumns({"net_minor": net_minor(), "amount_major": to_major(F.col("amount_minor")), "dedupe_key": dedupe_key()})


def rupees(minor: Column) -> Column:
    """Rs 1,234,567.80, with a sign before the digits."""
    return F.concat(F.lit("Rs "), F.format_number(to_major(minor), 2))
