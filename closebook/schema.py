"""The canonical table and the closed vocabularies."""

from __future__ import annotations

from decimal import Decimal

# Fixed values.
SOURCES = ("gateway", "settlement", "bank", "gl")
CURRENCIES = ("INR", "USD", "EUR", "GBP")
MINOR_DIGITS = 2
STATUSES = ("pending", "captured", "settled", "refunded", "partially_refunded", "failed", "reversed")
TIERS = ("exact", "rule", "fuzzy", "ml")
FX_TO_INR = {"USD": Decimal("83.20"), "EUR": Decimal("90.10"), "GBP": Decimal("105.40")}
GATEWAY_STATUS = {
    "created": "pending", "authorized": "pending", "captured": "captured", "settled": "settled",
    "refunded": "refunded", "partially_refunded": "partially_refunded", "failed": "failed", "reversed": "reversed",
}
GL_STATUS = {s: s for s in ("captured", "settled", "refunded", "partially_refunded", "failed", "reversed", "pending")}
OUTBOUND_GATEWAY = ("refunded", "reversed")
STATEMENT_MARKERS = ("opening balance", "closing balance", "statement summary")
SEVERITY = {
    "ambiguous_match": "medium", "one_to_many_unresolved": "medium", "amount_mismatch": "high", "no_counterpart": "high",
    "duplicate_suspected": "high", "stale_unmatched": "medium", "fx_unresolved": "medium",
}
DECISIONS = (
    "batch_started", "record_ingested", "record_deduplicated", "record_rejected",
    "match_made", "match_refused", "exception_raised", "batch_completed",
)

CANONICAL = (
    "seq long, txn_id string, source string, external_ref string, amount_minor long, currency string, fee_minor long, "
    "tax_minor long, direction string, value_date date, posted_at timestamp, status string, counterparty string, "
    "parent_ref string, group_ref string"
)
COLUMNS = [c.split()[0] for c in CANONICAL.split(", ")]

#: Matching: pass -> (tier, confidence).
PASSES = {"parent_ref": ("exact", 1.0), "group_ref": ("exact", 1.0), "economic_pair": ("rule", 0.95), "fx": ("rule", 0.92)}
#: What each pass links: the sources on its left, the source on its right.
LINKS = {"parent_ref": (("gateway", "settlement"), "gl"), "group_ref": (("settlement",), "bank"), "economic_pair": (("gl",), "bank"), "fx": (("gl",), "bank")}
LAG_DAYS, FX_TOLERANCE, BAND = 2, 100, 10_000
TWIN_DAYS, POOL_DAYS, POOL_LINES, GROUP_SIZES, GROUPINGS = 1, 4, 20, (2, 3, 4), 5
