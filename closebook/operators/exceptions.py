"""What stays unmatched becomes typed, priced exceptions, each subject under one category only."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded
from ..schema import GROUP_SIZES, GROUPINGS, LINKS, POOL_DAYS, POOL_LINES, SEVERITY, SOURCES, TWIN_DAYS
from ..storage import kept, unfolded, union_all


def twins(rows: DataFrame, unresolved: DataFrame, window_days: int = TWIN_DAYS) -> DataFrame:
    """Unresolved bank rows with a resolved bank row of the same economics nearby: suspected double payments.

    (primary_id, twin_id, lag, at_risk, currency, confidence); the nearest twin wins, then the first by seq.
    The key is party, amount and currency; references differ, as a source has each only once after dedupe.
    """
    bank = rows.filter("source = 'bank'").withColumn("party", folded(F.col("counterparty")))
    mine = unresolved.filter("source = 'bank'").withColumn("party", folded(F.col("counterparty")))
    known = bank.join(unresolved.select("txn_id"), "txn_id", "left_anti")
    keys = ["party", "amount_minor", "currency"]
    per_day = known.groupBy(*keys, F.col("value_date").alias("day")).agg(F.min(F.struct("seq", "txn_id")).alias("first"))
    lag = F.explode(F.sequence(F.lit(-window_days), F.lit(window_days))).alias("lag")
    near = unfolded(mine.select("txn_id", *keys, "value_date", lag).withColumn("day", F.date_add("value_date", F.col("lag"))))
    best = near.join(per_day, [*keys, "day"]).groupBy("txn_id", "amount_minor", "currency").agg(F.min(F.struct(F.abs("lag").alias("lag"), "first")).alias("b"))
    return best.select(
        F.col("txn_id").alias("primary_id"), F.col("b.first.txn_id").alias("twin_id"), F.col("b.lag").alias("lag"),
        F.col("amount_minor").alias("at_risk"), "currency", F.when(F.col("b.lag") == 0, 0.8).otherwise(0.65).cast("double").alias("confidence"),
    )


def matched_sources(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(txn_id, other): the sources that each matched record is linked with.

    A match's sources are bits, put together as its edges lie side by side, so edges and rows are joined once.
    """
    bit = F.expr("CASE source " + " ".join(f"WHEN '{s}' THEN {1 << i}" for i, s in enumerate(SOURCES)) + " END")
    left = F.col("side") == "left"
    known = edges.join(rows.select("txn_id", bit.alias("bit")), "txn_id").select("match_id", left.alias("on_left"), "txn_id", "bit")
    match = Window.partitionBy("match_id")
    across = F.when(F.col("on_left"), F.bit_or(F.when(~F.col("on_left"), F.col("bit"))).over(match)).otherwise(F.bit_or(F.when(F.col("on_left"), F.col("bit"))).over(match))
    per_record = known.select("txn_id", across.alias("bits")).filter("bits IS NOT NULL").groupBy("txn_id").agg(F.bit_or("bits").alias("bits"))
    named = F.expr("filter(array(" + ", ".join(f"if(bits & {1 << i} <> 0, '{s}', null)" for i, s in enumerate(SOURCES)) + "), s -> s IS NOT NULL)")
    return per_record.select("txn_id", F.explode(named).alias("other"))


def unbanked(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Settlement rows without a link to the bank, matched otherwise or not.

    Which sources a pass links is fixed, so edges of the other passes are not read, and no match is put together for it.
    """
    passes = [name for name, (left, right) in LINKS.items() if "settlement" in left and right == "bank"]
    linked = edges.filter(F.col("pass").isin(*passes) & (F.col("side") == "left")).select("txn_id")
    return rows.filter("source = 'settlement'").join(linked, "txn_id", "left_anti")


def pool(unresolved: DataFrame, lines: DataFrame) -> DataFrame:
    """For each unresolved inbound bank row the ``POOL_LINES`` nearest, then largest, unbanked lines of its party.

    Deposits and lines of a party and day are never all joined. Both are put in order of amount once; a
    deposit's place there says how many lines are too large for it, and the next POOL_LINES places are joined
    by number, so a deposit meets at most that many lines of each day, and of a day only as many as nearer days leave open.
    """
    key = ["currency", "party", "day"]
    deposits = unresolved.filter("source = 'bank' AND direction = 'inbound'").withColumn("party", folded(F.col("counterparty")))
    lag = F.explode(F.sequence(F.lit(-POOL_DAYS), F.lit(POOL_DAYS))).alias("lag")
    near = deposits.select(F.col("txn_id").alias("deposit_id"), F.col("amount_minor").alias("amount"), "currency", "party", "value_date", lag)
    near = unfolded(near.withColumn("day", F.date_add("value_date", F.col("lag"))).drop("value_date"))
    offered = lines.select(F.col("txn_id").alias("line_id"), F.col("amount_minor").alias("line"), "currency", folded(F.col("counterparty")).alias("party"), F.col("value_date").alias("day"), F.col("seq").alias("line_seq"))
    order = Window.partitionBy(*key).orderBy(F.desc("line"), "line_seq")
    ranked = kept(offered.withColumn("at", F.row_number().over(order)), "pool-lines")
    per_day = ranked.groupBy(*key).agg(F.max("at").alias("last"))
    # Of equal amounts a deposit stands before the lines: those are not too large.
    both = near.join(per_day, key).select(*key, "amount", "deposit_id", "lag", "last", F.lit(0).alias("is_line")).unionByName(
        ranked.select(*key, F.col("line").alias("amount"), F.lit(None).cast("string").alias("deposit_id"), F.lit(None).cast("int").alias("lag"), F.lit(None).cast("int").alias("last"), F.lit(1).alias("is_line"))
    )
    larger = F.sum("is_line").over(Window.partitionBy(*key).orderBy(F.desc("amount"), "is_line").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("larger", larger).filter("is_line = 0 AND larger < last")
    nearer = F.coalesce(F.sum(F.col("last") - F.col("larger")).over(Window.partitionBy("deposit_id").orderBy(F.abs("lag")).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = placed.withColumn("open", POOL_LINES - nearer).filter("open > 0")
    asked = open_.withColumn("at", F.explode(F.sequence(F.col("larger") + 1, F.least(F.col("larger") + F.col("open"), F.col("last").cast("long"))))).withColumn("at", F.col("at").cast("int"))
    joined = asked.join(ranked, [*key, "at"])
    place = F.row_number().over(Window.partitionBy("deposit_id").orderBy(F.abs("lag"), F.desc("line"), "line_seq"))
    return joined.withColumn("place", place).filter(F.col("place") <= POOL_LINES).select("deposit_id", F.col("amount").alias("deposit"), "currency", "line_id", "line", "place")


def _combinations() -> list[np.ndarray]:
    return [np.array(list(itertools.combinations(range(POOL_LINES), k))) for k in GROUP_SIZES]


def _subset_sums(batches):
    """The first GROUPINGS subsets, by size and then place, that add up to the deposit."""
    import pandas as pd

    tables = _combinations()
    for frame in batches:
        out = []
        for deposit_id, deposit, lines in zip(frame["deposit_id"], frame["deposit"], frame["lines"], strict=True):
            amounts = np.array([x["line"] for x in lines], dtype=np.int64)
            found = []
            for t in tables:
                t = t[t[:, -1] < len(amounts)]
                for c in t[amounts[t].sum(1) == deposit][: GROUPINGS - len(found)]:
                    found.append([lines[i]["line_id"] for i in c])
                if len(found) >= GROUPINGS:
                    break
            base = 0.75 if len(found) == 1 else 0.6
            for i, ids in enumerate(found):
                out.append((deposit_id, i, len(ids), ids, round(max(0.4, base - 0.05 * i), 2)))
        yield pd.DataFrame(out, columns=["deposit_id", "rank", "size", "line_ids", "confidence"])


def groupings(pooled: DataFrame) -> DataFrame:
    """(deposit_id, rank, size, line_ids, confidence). A deposit has at most POOL_LINES lines to combine."""
    gathered = pooled.groupBy("deposit_id", "deposit").agg(F.array_sort(F.collect_list(F.struct("place", "line_id", "line"))).alias("lines"))
    return gathered.mapInPandas(_subset_sums, "deposit_id string, rank int, size int, line_ids array<string>, confidence double")


#: Categories in the order of precedence, with their types; each is asked of a record's flags.
CATEGORIES = (
    ("one_to_many", "one_to_many_unresolved", "open AND offered > 0"), ("duplicate", "duplicate_suspected", "open AND double"), ("fx", "fx_unresolved", "open AND source = 'gl' AND currency <> 'INR'"),
    ("settled_never_received", "no_counterpart", "unbanked AND offered = 0"), ("no_counterpart", "no_counterpart", "open AND offered = 0"),
)


def cascade(rows: DataFrame, unresolved: DataFrame, lines: DataFrame, anomalies: DataFrame, groups: DataFrame) -> DataFrame:
    """All exceptions; the first category that fits claims its subject.

    What is unresolved, unbanked, offered a grouping and suspected is stacked and put together by record: each is
    shuffled once, and no set of claimed subjects is made that could be broadcast.
    """
    facts = ("source", "direction", "amount_minor", "currency")
    flags = {"open": "false", "unbanked": "false", "double": "false", "offered": "bigint(0)"}

    def flagged(df: DataFrame, subject: str, known: bool, **flag: str) -> DataFrame:
        of = [c if known else f"CAST(null AS {'bigint' if c == 'amount_minor' else 'string'}) AS {c}" for c in facts]
        return df.selectExpr(f"{subject} AS txn_id", *of, *(f"{flag.get(k, v)} AS {k}" for k, v in flags.items()))

    stacked = union_all([
        flagged(unresolved, "txn_id", True, open="true"), flagged(lines, "txn_id", True, unbanked="true"),
        flagged(groups, "deposit_id", False, offered="bigint(1)"), flagged(anomalies, "primary_id", False, double="true"),
    ])
    record = stacked.groupBy("txn_id").agg(*(F.max(c).alias(c) for c in (*facts, "open", "unbanked", "double")), F.sum("offered").alias("offered"))
    found = record.withColumn("found", F.expr("CASE " + " ".join(f"WHEN {asked} THEN {i}" for i, (_, _, asked) in enumerate(CATEGORIES)) + " END")).filter("found IS NOT NULL")
    of = lambda values: "CASE found " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
    return found.selectExpr(
        f"{of([c for c, _, _ in CATEGORIES])} AS category", f"{of([t for _, t, _ in CATEGORIES])} AS type", f"{of([SEVERITY[t] for _, t, _ in CATEGORIES])} AS severity", "txn_id AS subject_id", "source", "direction",
        "amount_minor AS at_risk", "currency", "CASE found WHEN 0 THEN offered WHEN 1 THEN bigint(1) ELSE bigint(0) END AS candidates",
    )


#: Why an exception of each category is one, and what to do about it; by direction where that matters.
REASONS = {
    "one_to_many": ("groups of settlement lines add up to this deposit, and no reference tells them apart", "confirm the group from the payout advice"),
    "duplicate": ("a matched bank row has the same party and amount on a near day", "check whether this is a second payment, and recover it if so"),
    "fx": ("no bank row is near the amount converted at the recorded rate", "check the rate that was applied on the day"),
    "settled_never_received": ("the settlement report has this payout, the bank has not", "ask the gateway where the payout is"),
    "no_counterpart inbound": ("nothing on another source accounts for this money in", "find the party and the missing entry"),
    "no_counterpart outbound": ("nothing on another source accounts for this payment", "find the party and the missing entry"),
}


def explained(found: DataFrame) -> DataFrame:
    """``found`` with ``reason`` and ``suggestion``."""
    key = F.when(F.col("category") == "no_counterpart", F.concat_ws(" ", "category", "direction")).otherwise(F.col("category"))
    texts = F.create_map(*[x for k, (why, what) in REASONS.items() for x in (F.lit(k), F.struct(F.lit(why).alias("why"), F.lit(what).alias("what")))])
    told = found.withColumn("told", F.try_element_at(texts, key))
    counted = F.when(F.col("category") == "one_to_many", F.concat(F.col("candidates").cast("string"), F.lit(" "), "told.why")).otherwise(F.col("told.why"))
    return told.select(*found.columns, counted.alias("reason"), F.col("told.what").alias("suggestion"))


def unexplained(unresolved: DataFrame, found: DataFrame) -> DataFrame:
    """Records that are neither matched nor the subject of an exception; there must be none."""
    return unresolved.join(found.select(F.col("subject_id").alias("txn_id")), "txn_id", "left_anti").select("txn_id")


def by_type(found: DataFrame) -> DataFrame:
    """Types with their numbers and money at risk, the most frequent first."""
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("at_risk").alias("at_risk")).orderBy(F.desc("n"), "type")


def by_type_and_currency(found: DataFrame) -> DataFrame:
    return found.groupBy("type", "currency").agg(F.count(F.lit(1)).alias("n"), F.sum("at_risk").alias("at_risk"))
