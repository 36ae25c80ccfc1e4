"""The four raw feeds: their shapes, emitters from canonical rows, and parsers back.

A parser turns raw rows into canonical columns plus ``outcome`` (ok, skip, reject), ``reason`` and
``locator``; bad rows never stop a batch, and no cast may fail at run time. Raw fields are strings (the
gateway's amounts and epoch are integers); nothing is inferred.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import lakh_grouped, plain, to_major, to_minor
from ..schema import COLUMNS, CURRENCIES, GATEWAY_STATUS, GL_STATUS, OUTBOUND_GATEWAY, STATEMENT_MARKERS
from ..storage import union_all

RAW = {
    "gateway": "seq long, id string, entity string, amount long, currency string, status string, order_id string, method string, captured boolean, fee long, tax long, created_at long, contact string",
    "settlement": "seq long, settlement_id string, payout_id string, order_id string, amount string, fee string, tax string, currency string, utr string, settled_at string, counterparty string, status string",
    "bank": "seq long, `Txn Date` string, `Value Date` string, Description string, `Ref No./Cheque No.` string, Debit string, Credit string, Balance string",
    "gl": "seq long, voucher_no string, gl_date string, account string, party string, debit string, credit string, narration string, currency string, status string",
}


class Connector(Protocol):
    """A pluggable source: raw rows in, canonical rows with outcome, reason and locator out."""

    def __call__(self, raw: DataFrame) -> DataFrame: ...


def read(spark: SparkSession, source: str, path: str, fmt: str = "json") -> DataFrame:
    """A feed from JSON lines, CSV or Parquet, with its declared schema."""
    reader = spark.read.schema(RAW[source])
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def missing_keys(source: str, df: DataFrame) -> list[str]:
    """Declared fields that a feed does not bring: the schema drift report."""
    there = {c.lower() for c in df.columns}
    return [f.name for f in df.sparkSession.createDataFrame([], RAW[source]).schema if f.name.lower() not in there]


# Emitters.


def emit(rows: DataFrame, source: str) -> DataFrame:
    rows = rows.filter(F.col("source") == source)
    inbound = F.col("direction") == "inbound"
    major = lambda c: to_major(F.col(c)).cast("string")
    if source == "gateway":
        return rows.select(
            "seq", F.col("external_ref").alias("id"), F.lit("payment").alias("entity"), F.col("amount_minor").alias("amount"), "currency", "status",
            F.col("parent_ref").alias("order_id"), F.lit("card").alias("method"), (F.col("status") != "failed").alias("captured"),
            F.col("fee_minor").alias("fee"), F.col("tax_minor").alias("tax"), F.unix_seconds("posted_at").alias("created_at"), F.col("counterparty").alias("contact"),
        )
    if source == "settlement":
        local = F.date_format(F.col("posted_at") + F.expr("interval 330 minutes"), "yyyy-MM-dd'T'HH:mm:ss")
        return rows.select(
            "seq", F.concat(F.lit("setl_"), "external_ref").alias("settlement_id"), F.col("external_ref").alias("payout_id"), F.col("parent_ref").alias("order_id"),
            major("amount_minor").alias("amount"), major("fee_minor").alias("fee"), major("tax_minor").alias("tax"), "currency",
            F.col("group_ref").alias("utr"), F.concat(local, F.lit("+05:30")).alias("settled_at"), "counterparty", F.lit("processed").alias("status"),
        )
    if source == "bank":
        day = F.date_format("value_date", "dd/MM/yyyy")
        kind = F.when(inbound, "NEFT CR-").otherwise("NEFT DR-")
        amount = lambda side: F.when(side, lakh_grouped(F.col("amount_minor"))).otherwise("")
        return rows.select(
            "seq", day.alias("Txn Date"), day.alias("Value Date"), F.concat(kind, "external_ref", F.lit("-"), "counterparty").alias("Description"),
            F.col("external_ref").alias("Ref No./Cheque No."), amount(~inbound).alias("Debit"), amount(inbound).alias("Credit"), F.lit("").alias("Balance"),
        )
    amount = lambda side: F.when(side, major("amount_minor")).otherwise("0.00")
    return rows.select(
        "seq", F.col("external_ref").alias("voucher_no"), F.col("value_date").cast("string").alias("gl_date"), F.lit("1200").alias("account"), F.col("counterparty").alias("party"),
        amount(inbound).alias("debit"), amount(~inbound).alias("credit"), F.lit("journal").alias("narration"), "currency", "status",
    )


# Parsers.


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _currency(c: str, default: str | None = None) -> Column:
    raw = F.upper(F.coalesce(F.col(c), F.lit(default))) if default else F.upper(F.col(c))
    return F.when(raw.isin(*CURRENCIES), raw)


def _money(c: str) -> Column:
    """Blank and missing are 0."""
    return to_minor(F.coalesce(plain(F.col(c)), F.lit("0")))


def _carried(raw: DataFrame) -> list[str]:
    """Where a row stood and the text of a line that can't be read, if the reader tells."""
    return [c for c in ("_place", "_damaged") if c in raw.columns]


def _once(df: DataFrame) -> DataFrame:
    """The columns of ``df``, computed once a row.

    A filter on what is made of them (as ``outcome``) would be put below them by the planner, with a copy of an amount's or a date's
    whole parsing wherever its conditions name one; it does not pass an ``inline``.
    """
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def _finish(df: DataFrame, source: str, ref: str, reasons: list[tuple[Column, str]], skip: Column | None = None) -> DataFrame:
    """The first reason that holds rejects a row; skipped rows are judged before any reason.

    A row is located by its reference, or by its place where it has none or can't be read.
    """
    df = _once(df)
    damaged = [(F.col("_damaged").isNotNull(), "malformed_record")] if "_damaged" in df.columns else []
    place = [F.col("_place")] if "_place" in df.columns else []
    read = [F.when(damaged[0][0], place[0])] if damaged and place else []  # what was read of a damaged line is not relied on
    checks = [*damaged, *reasons, (F.col("amount_minor") < 0, "negative_amount"), ((F.col("fee_minor") < 0) | (F.col("tax_minor") < 0), "negative_fee"), ((F.col("amount_minor") > 0) & (F.col("fee_minor") > F.col("amount_minor")), "fee_above_amount")]
    reason = F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in checks))
    skipped = F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False)
    named = df.withColumns({"source": F.lit(source), "external_ref": F.trim(F.col(f"`{ref}`"))})
    named = named.withColumns({"txn_id": F.concat_ws(":", "source", "external_ref"), "locator": F.coalesce(*read, F.nullif("external_ref", F.lit("")), *place, F.lit("")), "reason": F.when(~skipped, reason)})
    outcome = F.when(skipped, "skip").when(F.col("reason").isNotNull(), "reject").otherwise("ok")
    return named.withColumn("outcome", outcome).select(*COLUMNS, "outcome", "reason", "locator")


def parse_gateway(raw: DataFrame) -> DataFrame:
    posted = F.timestamp_seconds(F.col("created_at"))
    df = raw.select(
        "seq", "id", F.col("amount").alias("amount_minor"), _currency("currency").alias("currency"), F.coalesce("fee", F.lit(0)).alias("fee_minor"), F.coalesce("tax", F.lit(0)).alias("tax_minor"),
        F.when(F.col("status").isin(*OUTBOUND_GATEWAY), "outbound").otherwise("inbound").alias("direction"), F.to_date(posted).alias("value_date"), posted.alias("posted_at"),
        _lookup(GATEWAY_STATUS, F.col("status")).alias("status"), F.col("contact").alias("counterparty"), F.col("order_id").alias("parent_ref"), F.lit(None).cast("string").alias("group_ref"), *_carried(raw),
    )
    return _finish(df, "gateway", "id", [(_blank("id"), "missing_reference"), (F.col("status").isNull(), "unknown_status"), (F.col("currency").isNull(), "unknown_currency"), (F.col("amount_minor").isNull(), "bad_amount"), (F.col("posted_at").isNull(), "bad_date")])


def parse_settlement(raw: DataFrame) -> DataFrame:
    """Times need an explicit offset and become UTC, which may move the date back."""
    zoned = F.when(F.regexp_like("settled_at", F.lit(r"(Z|[+-]\d\d:?\d\d)$")), F.try_to_timestamp("settled_at"))
    df = raw.select(
        "seq", "payout_id", _money("amount").alias("amount_minor"), _currency("currency").alias("currency"), _money("fee").alias("fee_minor"), _money("tax").alias("tax_minor"),
        F.lit("inbound").alias("direction"), F.to_date(zoned).alias("value_date"), zoned.alias("posted_at"), F.lit("settled").alias("status"), "counterparty",
        F.col("order_id").alias("parent_ref"), F.nullif("utr", F.lit("")).alias("group_ref"), *_carried(raw),
    )
    bad = F.col("amount_minor").isNull() | F.col("fee_minor").isNull() | F.col("tax_minor").isNull()
    return _finish(df, "settlement", "payout_id", [(_blank("payout_id"), "missing_reference"), (F.col("currency").isNull(), "unknown_currency"), (bad, "bad_amount"), (F.col("posted_at").isNull(), "bad_date")])


def parse_bank(raw: DataFrame, currency: str = "INR") -> DataFrame:
    """Statement lines; opening, closing and summary lines are skipped before anything else is judged."""
    ref = "Ref No./Cheque No."
    debit, credit = plain(F.col("Debit")), plain(F.col("Credit"))
    one = debit.isNull() != credit.isNull()
    day = lambda c: F.to_date(F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")), F.lit("d/M/yyyy")))
    value = day(F.col("Value Date"))
    txn = day(F.coalesce(F.nullif(F.trim("Txn Date"), F.lit("")), F.col("Value Date")))
    said = F.lower(F.coalesce("Description", F.lit("")))
    skip = F.lit(False)
    for marker in STATEMENT_MARKERS:
        skip = skip | said.contains(marker)
    df = raw.select(
        "seq", F.col(f"`{ref}`").alias("ref"), to_minor(F.coalesce(credit, debit)).alias("amount_minor"), F.lit(currency).alias("currency"), F.lit(0).cast("bigint").alias("fee_minor"),
        F.lit(0).cast("bigint").alias("tax_minor"), F.when(credit.isNotNull(), "inbound").otherwise("outbound").alias("direction"), value.alias("value_date"),
        txn.cast("timestamp").alias("posted_at"), F.lit("settled").alias("status"), F.nullif(F.trim(F.try_element_at(F.split("Description", "-"), F.lit(3))), F.lit("")).alias("counterparty"),
        F.lit(None).cast("string").alias("parent_ref"), F.lit(None).cast("string").alias("group_ref"), one.alias("one"), skip.alias("skip"), *_carried(raw),
    )
    return _finish(df, "bank", "ref", [(_blank("ref"), "missing_reference"), (~F.col("one"), "debit_and_credit"), (F.col("amount_minor").isNull(), "bad_amount"), (F.col("value_date").isNull() | F.col("posted_at").isNull(), "bad_date")], F.col("skip"))


def parse_gl(raw: DataFrame) -> DataFrame:
    """Debit is money in. A row with both sides, no side or a negative side is rejected."""
    df = raw.select(
        "seq", "voucher_no", _money("debit").alias("d"), _money("credit").alias("c"), _currency("currency", "INR").alias("currency"), F.lit(0).cast("bigint").alias("fee_minor"),
        F.lit(0).cast("bigint").alias("tax_minor"), F.to_date(F.try_to_timestamp("gl_date", F.lit("yyyy-MM-dd"))).alias("value_date"), _lookup(GL_STATUS, F.col("status")).alias("status"),
        F.col("party").alias("counterparty"), F.lit(None).cast("string").alias("parent_ref"), F.lit(None).cast("string").alias("group_ref"), *_carried(raw),
    )
    df = df.withColumns({"amount_minor": F.when(F.col("d") > 0, F.col("d")).otherwise(F.col("c")), "direction": F.when(F.col("d") > 0, "inbound").otherwise("outbound"), "posted_at": F.col("value_date").cast("timestamp")})
    return _finish(df, "gl", "voucher_no", [
        (_blank("voucher_no"), "missing_reference"), (F.col("d").isNull() | F.col("c").isNull(), "bad_amount"), ((F.col("d") < 0) | (F.col("c") < 0), "negative_amount"),
        ((F.col("d") > 0) & (F.col("c") > 0), "compound_entry"), ((F.col("d") == 0) & (F.col("c") == 0), "empty_entry"), (F.col("status").isNull(), "unknown_status"),
        (F.col("currency").isNull(), "unknown_currency"), (F.col("value_date").isNull(), "bad_date"),
    ])


CONNECTORS: dict[str, Connector] = {"gateway": parse_gateway, "settlement": parse_settlement, "bank": parse_bank, "gl": parse_gl}


def parse_all(raw: dict[str, DataFrame], connectors: dict[str, Connector] | None = None) -> DataFrame:
    """All feeds through their connectors; a feed without one is an error before anything runs."""
    known = connectors or CONNECTORS
    if unknown := sorted(set(raw) - set(known)):
        raise KeyError(f"no connector for {unknown}")
    return union_all([known[s](df) for s, df in raw.items()])


def planted_bad(spark: SparkSession) -> dict[str, DataFrame]:
    """Rows that every run must reject or skip."""
    rows = {
        "gateway": [(-1, "", "payment", 100, "INR", "captured", None, "card", True, 0, 0, 0, None), (-2, "pay_x1", "payment", 100, "INR", "lost", None, "card", True, 0, 0, 0, None), (-3, "pay_x2", "payment", 100, "XYZ", "captured", None, "card", True, 0, 0, 0, None), (-4, "pay_x3", "payment", 100, "INR", "captured", None, "card", True, 200, 0, 0, None)],
        "settlement": [(-5, "s", "pout_x1", None, "1.234", "0", "0", "INR", None, "2026-08-02T02:00:00+05:30", None, "x"), (-6, "s", "pout_x2", None, "1.00", "0", "0", "INR", None, "2026-08-02T02:00:00", None, "x"), (-7, "s", None, None, "1.00", "0", "0", "INR", None, "2026-08-02T02:00:00Z", None, "x")],
        "bank": [(-8, "01/08/2026", "01/08/2026", "OPENING BALANCE", "", "", "", "1.00"), (-9, "01/08/2026", "01/08/2026", "NEFT CR-a-b", "", "", "1.00", ""), (-10, "01/08/2026", "01/08/2026", "NEFT CR-a-b", "UTR_x1", "1.00", "1.00", ""), (-11, "2026-08-02", "2026-08-02", "NEFT CR-a-b", "UTR_x2", "", "1.00", ""), (-12, "01/08/2026", "01/08/2026", "NEFT CR-a-b", "UTR_x3", "", "", "")],
        "gl": [(-13, "v_x1", "2026-08-01", "a", "p", "1.00", "1.00", "n", "INR", "settled"), (-14, "v_x2", "2026-08-01", "a", "p", "0.00", "0.00", "n", "INR", "settled"), (-15, "v_x3", "2026-08-01", "a", "p", "-1.00", "0", "n", "INR", "settled"), (-16, "v_x4", "2026-08-01", "a", "p", "1.00", "0", "n", "INR", "gone")],
    }
    return {s: spark.createDataFrame(r, RAW[s]) for s, r in rows.items()}
