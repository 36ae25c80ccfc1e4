"""Filtered pages over a run. Cursors are opaque and hold the last row's key, so no page is skipped or repeated and none
scans the others."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .exceptions import explained
from .matching import told

LIMIT, MOST = 100, 500
TRANSACTION = ["txn_id", "source", "external_ref", "amount_minor", "currency", "fee_minor", "tax_minor", "direction", "value_date", "posted_at", "status", "counterparty", "parent_ref", "group_ref"]


class BadPage(ValueError):
    """A limit or cursor that no page has."""


def _limit(limit: int) -> int:
    if limit < 1:
        raise BadPage("a page has at least one row")
    return min(limit, MOST)


def _where(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; a value that does not occur gives an empty page."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


@dataclass(frozen=True)
class Page:
    """Rows of one page, and the opaque cursor of the next, which is None on the last."""

    items: list
    next: str | None


#: List -> its order, as (column, descending?).
ORDERS = {
    "transactions": (("txn_id", False),),
    "exceptions": (("at_risk", True), ("subject_id", False)),
    "matches": (("match_id", False),),
    "audit": (("phase", False), ("subject", False), ("reason", False)),
    "cash": (("day", False),),
}


def _cursor(values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, default=str).encode()).decode()


def _opened(cursor: str) -> list:
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError:
        raise BadPage("no page has this cursor") from None
    if not isinstance(values, list):
        raise BadPage("no page has this cursor")
    return values


#: What orders rows that are equal in a list's own order: only rows that are alike in all columns share it.
ROW = "row_key"


def _behind(df: DataFrame, order: list[tuple[str, bool]], values: list, also_equal: bool) -> DataFrame:
    """Rows after ``values`` in an order that has nulls last, and those at it if wanted."""
    behind, equal = F.lit(False), F.lit(True)
    for (c, down), value in zip(order, values, strict=True):
        at = F.lit(value).cast(df.schema[c].dataType)
        further = F.lit(False) if value is None else F.coalesce((F.col(c) < at) if down else (F.col(c) > at), F.lit(True))
        behind = behind | (equal & further)
        equal = equal & F.col(c).eqNullSafe(at)
    return df.filter(behind | equal if also_equal else behind)


def rows_after(df: DataFrame, name: str, cursor: str | None, keyed: bool = False) -> DataFrame:
    """The rows of a list behind a cursor, in the list's order; rows alike in all columns are told apart by their number.

    A cursor holds the last row's key and how many rows with just this key have been served. One that holds only the
    list's own columns stands behind all rows that are equal in them.
    """
    own = list(ORDERS[name])
    order = [*own, (ROW, False)]
    listed = df.withColumn(ROW, F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))), 256))
    skip = 0
    if cursor is not None:
        values = _opened(cursor)
        if len(values) == len(own):
            listed = _behind(listed, own, values, False)
        elif len(values) == len(order) + 1 and isinstance(values[-1], int) and values[-1] >= 0:
            listed, skip = _behind(listed, order, values[:-1], True), values[-1]
        else:
            raise BadPage("no page has this cursor")
    listed = listed.orderBy(*(F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order))
    listed = listed.offset(skip) if skip else listed
    return listed if keyed else listed.drop(ROW)


def page(df: DataFrame, name: str, cursor: str | None = None, limit: int = LIMIT) -> Page:
    """One page of a list; one row more than asked for tells whether there is another. Every row is on one page."""
    limit = _limit(limit)
    found = rows_after(df, name, cursor, keyed=True).limit(limit + 1).collect()
    items = [Row(**{c: r[c] for c in df.columns}) for r in found[:limit]]
    if len(found) <= limit:
        return Page(items, None)
    last = [found[limit - 1][c] for c, _ in [*ORDERS[name], (ROW, False)]]
    served = sum(r[ROW] == last[-1] for r in found[:limit])
    if served == limit and cursor is not None and len(before := _opened(cursor)) == len(last) + 1 and before[-2] == last[-1]:
        served += before[-1]  # the page is full of rows like the last one of the page before
    return Page(items, _cursor([*last, served]))


def transactions(rows: DataFrame, source: str | None = None) -> DataFrame:
    return _where(rows.select(*TRANSACTION), source=source)


def transactions_page(rows: DataFrame, source: str | None = None, after: str | None = None, limit: int = LIMIT) -> DataFrame:
    return rows_after(transactions(rows, source), "transactions", None if after is None else _cursor([after])).limit(_limit(limit))


def exceptions_page(found: DataFrame, type: str | None = None, severity: str | None = None, after: tuple[int, str] | None = None, limit: int = LIMIT) -> DataFrame:
    """Most money at risk first; ``after`` is (at_risk, subject_id) of the last row seen."""
    return rows_after(_where(found, type=type, severity=severity), "exceptions", None if after is None else _cursor(list(after))).limit(_limit(limit))


def matches_page(matches: DataFrame, tier: str | None = None, after: str | None = None, limit: int = LIMIT) -> DataFrame:
    return rows_after(_where(matches, tier=tier), "matches", None if after is None else _cursor([after])).limit(_limit(limit))


def audit_list(entries: DataFrame, decision: str | None = None) -> DataFrame:
    """Entries with the columns that order them."""
    return _where(entries, decision=decision).withColumns({"subject": F.concat_ws(",", "subjects"), "reason": F.coalesce("reason", F.lit(""))})


def audit_page(entries: DataFrame, decision: str | None = None, after: str | None = None, limit: int = LIMIT) -> DataFrame:
    return rows_after(audit_list(entries, decision), "audit", after).drop("subject").limit(_limit(limit))


def exception(found: DataFrame, subject_id: str):
    """Point lookup: the exception of a subject, or None."""
    return found.filter(F.col("subject_id") == subject_id).first()


def summary(rows: DataFrame, edges: DataFrame, found: DataFrame, matched: int | None = None, matches: int | None = None) -> DataFrame:
    """One row about the current batch; who knows the numbers of ``matched`` records and of ``matches`` gives them."""
    total = rows.agg(F.count(F.lit(1)).alias("records"))
    if matched is None or matches is None:
        matched = edges.agg(F.count_distinct("txn_id").alias("matched"), F.count_distinct("match_id").alias("matches"))
    else:
        matched = edges.sparkSession.createDataFrame([(matched, matches)], "matched long, matches long")
    open_ = found.agg(F.count(F.lit(1)).alias("exceptions"), F.coalesce(F.sum("at_risk"), F.lit(0)).alias("at_risk"))
    return total.join(F.broadcast(matched)).join(F.broadcast(open_))  # one row each


def wire_matches(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Matches as they are served: pass, tier, confidence, sizes and the reason."""
    return told(edges, rows).drop("right_id")


def wire_exceptions(found: DataFrame) -> DataFrame:
    """Exceptions as they are served: money as one struct, with reason and suggestion."""
    return money_out(explained(found), "at_risk")


def totals(found: DataFrame) -> DataFrame:
    """Money at risk and number of exceptions by currency."""
    return found.groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.sum("at_risk").alias("at_risk")).orderBy("currency")


def money_out(df: DataFrame, amount: str = "amount_minor") -> DataFrame:
    """The wire form of money: one struct of amount and currency."""
    return df.withColumn("money", F.struct(F.col(amount).alias("amount_minor"), "currency")).drop(amount, "currency")
