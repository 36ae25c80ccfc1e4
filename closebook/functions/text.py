"""Names compared two ways, references, and redaction of personal data."""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
SENSITIVE = ("counterparty", "contact", "party", "description", "narration", "raw", "email", "phone", "address")
EMAIL = r"\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?91[-\s]?)?\b[6-9]\d{9}\b"
ACCOUNT = r"\b\d{5,14}(\d{4})\b"
NOT_NAMES = ("NEFT CR", "NEFT DR")
NAME = rf"\b(?!(?:{'|'.join(NOT_NAMES)})\b(?!\s+[A-Z][A-Z]))[A-Z][A-Z]+(?:\s+[A-Z][A-Z]+)+\b"
SAFE_SUMMARY = ("ref", "amount_minor", "currency", "direction", "value_date", "status")


def collapsed(name: Column) -> Column:
    """For matching: blanks collapsed and lower-cased; no name equals no name."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")))


def folded(name: Column) -> Column:
    """For anomalies and groupings: lower-cased only."""
    return F.lower(F.coalesce(name, F.lit("")))


def safe_ref() -> Column:
    return F.concat_ws(":", "source", "external_ref")


def _ascii(pattern: str) -> str:
    """``pattern`` for Java, whose word boundary knows letters beyond ASCII (up to JDK 18) and whose blank has a vertical tab: as in SQL, neither here."""
    word = "[0-9A-Za-z_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))").replace(r"\s", r"[ \t\n\f\r]")


def redact(text: Column) -> Column:
    """Mail addresses, phones, account numbers (last four digits stay) and capitalised names, in this order."""
    out = F.regexp_replace(text, _ascii(EMAIL), "[EMAIL]")
    out = F.regexp_replace(out, _ascii(PHONE), "[PHONE]")
    out = F.regexp_replace(out, _ascii(ACCOUNT), "[ACCT:$1]")
    return F.regexp_replace(out, _ascii(NAME), "[NAME]")


def _sensitive(key: Column) -> Column:
    return F.lower(key).isin(*SENSITIVE)


def redact_row(df: DataFrame) -> DataFrame:
    """Sensitive columns are blanked whole, other text is redacted; structs and maps are walked, lists one level, variants in full.

    A map's key decides as a column's name does; where its values are no text, a sensitive one becomes null.
    """

    def walk(c: Column, name: str, kind: T.DataType, listed: bool = False) -> Column:
        if name.lower() in SENSITIVE:
            return F.when(c.isNotNull(), F.lit("[REDACTED]"))
        if isinstance(kind, T.StringType):
            return redact(c)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(walk(c[f.name], f.name, f.dataType).alias(f.name) for f in kind)))
        if isinstance(kind, T.MapType):
            blank = F.lit("[REDACTED]") if isinstance(kind.valueType, T.StringType) else F.lit(None).cast(kind.valueType)
            secret = (lambda k, v: _sensitive(k)) if isinstance(kind.keyType, T.StringType) else lambda k, v: F.lit(False)
            return F.transform_values(c, lambda k, v: F.when(secret(k, v), blank).otherwise(walk(v, "", kind.valueType)))
        if isinstance(kind, T.ArrayType) and not listed:
            return F.transform(c, lambda x: walk(x, "", kind.elementType, True))
        if isinstance(kind, T.VariantType):
            return F.parse_json(redact_json(F.to_json(c)))
        return c

    return df.select(*(walk(F.col(f"`{f.name}`"), f.name, f.dataType).alias(f.name) for f in df.schema))


_EMAIL, _PHONE, _ACCOUNT = (re.compile(p.replace(r"[-\s]", r"[- \t\n\f\r]"), re.ASCII) for p in (EMAIL, PHONE, ACCOUNT))
_NAME = re.compile(NAME.replace(r"\s", r"[ \t\n\f\r]"), re.ASCII)


def _redacted(value, listed: bool = False):
    """One parsed JSON value; the same rules as ``redact_row``."""
    if isinstance(value, str):
        value = _ACCOUNT.sub(r"[ACCT:\1]", _PHONE.sub("[PHONE]", _EMAIL.sub("[EMAIL]", value)))
        return _NAME.sub("[NAME]", value)
    if isinstance(value, dict):
        return {k: "[REDACTED]" if k.casefold() in SENSITIVE else _redacted(v) for k, v in value.items()}
    if isinstance(value, list) and not listed:
        return [_redacted(v, True) for v in value]
    return value


def redact_json(text: Column) -> Column:
    """Payloads without a schema, as JSON text: walked at run time. What is no JSON is redacted as text."""

    def one(raw: str | None) -> str | None:
        if raw is None:
            return None
        try:
            value = json.loads(raw, parse_float=Decimal)
        except (ValueError, RecursionError):
            return _redacted(raw)
        return json.dumps(_redacted(value), ensure_ascii=False, separators=(",", ":"), default=float)

    return F.pandas_udf(lambda column: column.map(one, na_action="ignore"), "string")(text)


def safe_summary(df: DataFrame) -> DataFrame:
    """The only projection of transactions that may be logged: an allow-list."""
    return df.withColumn("ref", safe_ref()).select(*SAFE_SUMMARY)
