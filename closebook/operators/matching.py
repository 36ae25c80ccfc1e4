"""The match cascade: two reference joins on the full batch, two economic joins on what they leave.

A pass gives edges (match_id, pass, side, txn_id) and pairs nothing whose key has more than one candidate.
No pass joins rows with rows of one economic key: counts by key and day are joined instead, so a key that
a third of all rows share costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import band, fx_to_inr
from ..functions.text import collapsed
from ..schema import BAND, FX_TOLERANCE, LAG_DAYS, PASSES
from ..storage import kept, unfolded, union_all

EDGES = "match_id string, pass string, side string, txn_id string"


def _edges(pairs: DataFrame, name: str, key: str = "left_id") -> DataFrame:
    """Edges of pairs (left_id, right_id)."""
    match = F.concat(F.lit(f"{name}|"), F.col(key))
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("txn_id")) for s in ("left", "right")))
    return pairs.select(match.alias("match_id"), F.lit(name).alias("pass"), F.explode(sides).alias("e")).select("match_id", "pass", "e.side", "e.txn_id")


def parent_ref(rows: DataFrame) -> DataFrame:
    """Gateway and settlement rows to the one gl row with their parent reference and currency."""
    key = ["external_ref", "currency"]  # dealt before it is grouped: rows have one place each, so grouping where they lie would only sort them once more
    book = rows.filter("source = 'gl'").select(*key, "txn_id").repartition(*key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("txn_id").alias("right_id")).filter("n = 1")
    child = rows.filter("source IN ('gateway', 'settlement') AND parent_ref IS NOT NULL AND parent_ref <> ''")
    child = child.select(F.col("txn_id").alias("left_id"), F.col("parent_ref").alias("external_ref"), "currency")
    return _edges(child.join(book, key), "parent_ref")


def group_pairs(rows: DataFrame) -> DataFrame:
    """(ref, bank_id): groups of settlement lines that one bank row confirms in currency and to the minor unit."""
    lines = rows.filter("source = 'settlement' AND group_ref IS NOT NULL AND group_ref <> ''")
    group = lines.groupBy(F.col("group_ref").alias("ref")).agg(F.sum("amount_minor").alias("total"), F.min("currency").alias("lo"), F.max("currency").alias("hi"))
    bank = rows.filter("source = 'bank'").select(F.col("external_ref").alias("ref"), "txn_id", "amount_minor", "currency").repartition("ref").groupBy("ref").agg(
        F.count(F.lit(1)).alias("n"), F.min("txn_id").alias("bank_id"), F.min("amount_minor").alias("amount"), F.min("currency").alias("currency")
    )
    return group.join(bank.filter("n = 1"), "ref").filter("lo = hi AND lo = currency AND total = amount").select("ref", "bank_id")


def group_ref(rows: DataFrame) -> DataFrame:
    pairs = group_pairs(rows)
    match = F.concat(F.lit("group_ref|"), F.col("bank_id")).alias("match_id")
    lines = rows.filter("source = 'settlement'").join(pairs, F.col("group_ref") == F.col("ref")).select(match, F.lit("group_ref").alias("pass"), F.lit("left").alias("side"), "txn_id")
    return lines.unionByName(pairs.select(match, F.lit("group_ref").alias("pass"), F.lit("right").alias("side"), F.col("bank_id").alias("txn_id")))


def _mutual(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(left_id, right_id): each is the other's only candidate by ``keys`` and a lag of 0 to LAG_DAYS days."""
    days = F.explode(F.sequence(F.lit(0), F.lit(LAG_DAYS))).alias("lag")

    def only(probe: DataFrame, build: DataFrame, sign: int, mine: str, other: str) -> DataFrame:
        per_day = build.groupBy(*keys, F.col("value_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("txn_id").alias(other))
        near = probe.select(F.col("txn_id").alias(mine), *keys, "value_date", days).withColumn("day", F.date_add("value_date", F.col("lag") * sign))
        return unfolded(near).join(per_day, [*keys, "day"]).groupBy(mine).agg(F.sum("n").alias("n"), F.min(other).alias(other)).filter("n = 1").drop("n")

    return only(left, right, 1, "left_id", "right_id").join(only(right, left, -1, "right_id", "left_id"), ["left_id", "right_id"])


def _sides(rows: DataFrame, resolved: DataFrame | None, book: Column, bank: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of either side that are not resolved; without ``resolved``, none of ``rows`` is."""
    of = lambda source, extra: rows.filter((F.col("source") == source) & extra)
    free = of if resolved is None else lambda source, extra: of(source, extra).join(resolved, "txn_id", "left_anti")
    return free("gl", book), free("bank", bank)


ECONOMIC = ["currency", "direction", "amount_minor", "party"]


def economic_pair(rows: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Strict mode: order-free, a subset of the greedy pairs."""
    book, bank = _sides(rows.withColumn("party", collapsed(F.col("counterparty"))), resolved, F.lit(True), F.lit(True))
    return _edges(_mutual(book, bank, ECONOMIC), "economic_pair")


def fx_candidates(rows: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Foreign gl rows, INR bank rows, and the pairs within tolerance of bank *amounts* by day.

    Bands of the expected amount make the range condition an equi-join; a band is as wide as the tolerance, so an entry
    meets at most three times that many amounts of a day, however many rows there are.
    """
    book, bank = _sides(rows, resolved, F.col("currency") != "INR", F.col("currency") == "INR")
    book = book.withColumn("expected", fx_to_inr(F.col("amount_minor"), F.col("currency"))).filter("expected IS NOT NULL")
    by_amount = bank.groupBy("direction", "value_date", "amount_minor").agg(F.count(F.lit(1)).alias("n"), F.min("txn_id").alias("right_id"))
    by_amount = by_amount.withColumn("band", band(F.col("amount_minor"), FX_TOLERANCE + 1))
    lags, bands = F.explode(F.sequence(F.lit(0), F.lit(LAG_DAYS))), F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1))
    near = book.select(F.col("txn_id").alias("left_id"), "direction", "expected", F.col("value_date").alias("from_day"), band(F.col("expected"), FX_TOLERANCE + 1).alias("b"), lags.alias("lag"))
    near = unfolded(near.withColumn("band", bands).withColumn("value_date", F.date_add("from_day", "lag")))
    return book, bank, near.join(by_amount, ["direction", "value_date", "band"]).filter(F.abs(F.col("amount_minor") - F.col("expected")) <= FX_TOLERANCE)


def fx(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Strict mode of the converted range join."""
    near = kept(fx_candidates(rows, resolved)[2].select("left_id", "right_id", "n", "direction", "value_date", "amount_minor"), "fx-pairs")
    only = near.groupBy("left_id").agg(F.sum("n").alias("n"), F.min("right_id").alias("right_id")).filter("n = 1").drop("n")
    # The other direction: gl rows for each bank row, by the bank row's amount and day.
    wanted = near.groupBy("direction", "value_date", "amount_minor").agg(F.count(F.lit(1)).alias("books"))
    claimed = near.join(wanted.filter("books = 1"), ["direction", "value_date", "amount_minor"]).select("left_id", "right_id")
    return _edges(only.join(claimed, ["left_id", "right_id"]), "fx")


PAIRS = ["left_id", "seq", "alike", "zone", "right_id"]


def _claims(pairs: DataFrame) -> DataFrame:
    """(left_id, right_id) of the claims that entries make in order, each taking its only row that is still free.

    ``pairs`` has entries (left_id, seq) with the rows that each may take; entries of one ``alike`` may take the same
    rows, and no two ``zone`` have a row in common. Claims are settled in rounds of joins and grouped minima. In each round:

    * An entry with one free row claims it if no earlier open entry sees that row, or none in its zone has a single row.
    * Before the first entry of a zone that has a single row, nothing in the zone is claimed: earlier entries are refused.
    * An entry that sees two rows which no earlier open entry of another kind sees will find both free, and is refused.

    What is settled leaves, with the rows claimed. Every round settles at least one entry in each zone, and all before it; a zone needs at
    most as many rounds as it has claims. No entry's or row's pairs are gathered anywhere.
    """
    claimed: list[DataFrame] = []
    ordered = pairs.select(*PAIRS).distinct().withColumn("seq", F.struct("seq", "left_id"))  # no two entries are at one place
    live = kept(ordered, "claims-open")
    while not live.isEmpty():
        mine = live.groupBy("left_id", "seq", "zone").agg(F.count(F.lit(1)).alias("free"))
        first_single = mine.filter("free = 1").groupBy("zone").agg(F.min("seq").alias("starts"))
        seen = live.groupBy("right_id", "alike").agg(F.min("seq").alias("seq"))
        first = seen.groupBy("right_id").agg(F.min(F.struct("seq", "alike")).alias("first"))
        second = seen.join(first, "right_id").filter("alike <> first.alike").groupBy("right_id").agg(F.min("seq").alias("second"))
        bank = first.join(second, "right_id", "left")
        told = live.join(bank, "right_id").withColumn("other", F.when(F.col("alike") == F.col("first.alike"), F.col("second")).otherwise(F.col("first.seq")))
        judged = told.groupBy("left_id", "seq", "zone").agg(
            F.count(F.lit(1)).alias("free"), F.min("right_id").alias("right_id"), F.min(F.col("first.seq")).alias("earliest"), F.count_if(F.col("other").isNull() | (F.col("other") > F.col("seq"))).alias("sure"),
        ).join(first_single, "zone", "left")
        now = (F.col("free") == 1) & ((F.col("earliest") == F.col("seq")) | (F.col("starts") == F.col("seq")))
        refused = (F.col("free") > 1) & (F.col("starts").isNull() | (F.col("seq") < F.col("starts")) | (F.col("sure") > 1))
        settled = kept(judged.select("left_id", "right_id", now.alias("claims"), refused.alias("refused")).filter("claims OR refused"), "claims-settled")
        won = settled.filter("claims").select("left_id", "right_id")
        claimed.append(won)
        left = live.join(settled.select("left_id"), "left_id", "left_anti").join(won.select("right_id"), "right_id", "left_anti")
        live = kept(left.select(*PAIRS), "claims-open")
    return union_all(claimed) if claimed else live.select("left_id", "right_id")


def _contested(book: DataFrame, bank: DataFrame, strict: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides without the pairs of the strict mode, which the ordered claims make too and nothing else can touch."""
    strict = kept(strict, "strict")
    done = strict.select("txn_id")
    return book.join(done, "txn_id", "left_anti"), bank.join(done, "txn_id", "left_anti"), strict


def economic_pair_greedy(rows: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """The ordered variant: a gl row takes its only bank row that no earlier one has taken.

    The strict pairs come first. A day of a key with two or more free bank rows can never be claimed from, as
    every claim needs a single candidate, so rows that see such a day are out, and each day left has one bank
    row at most: a gl row has at most a row for each day of the lag.
    """
    book, bank = _sides(rows.withColumn("party", collapsed(F.col("counterparty"))), resolved, F.lit(True), F.lit(True))
    book, bank, strict = _contested(book, bank, economic_pair(rows, resolved))
    days = F.explode(F.sequence(F.lit(0), F.lit(LAG_DAYS))).alias("lag")
    per_day = bank.groupBy(*ECONOMIC, F.col("value_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("txn_id").alias("right_id"))
    near = unfolded(book.select(F.col("txn_id").alias("left_id"), "seq", *ECONOMIC, "value_date", days).withColumn("day", F.date_add("value_date", F.col("lag"))))
    seen = near.join(per_day, [*ECONOMIC, "day"])
    zone = F.to_json(F.struct(*ECONOMIC))
    seen = seen.select("left_id", "seq", F.concat(zone, F.col("value_date").cast("string")).alias("alike"), zone.alias("zone"), "right_id", "n")
    return strict.unionByName(_edges(_claims(_single(seen)), "economic_pair"))


def _single(seen: DataFrame) -> DataFrame:
    """The pairs of entries that see no place with ``n`` > 1 rows: such rows are never claimed, and who sees them claims none."""
    return seen.join(seen.filter("n > 1").select("left_id").distinct(), "left_id", "left_anti")


def fx_greedy(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """The ordered variant of the converted range join, for rows that the strict mode leaves contested."""
    strict = kept(fx(rows, resolved), "strict")
    done = resolved.unionByName(strict.select("txn_id")).distinct()
    book, _, near = fx_candidates(rows, done)
    order = book.select(F.col("txn_id").alias("left_id"), "seq")
    near = near.withColumn("cell", band(F.col("expected"), FX_TOLERANCE + 1)).withColumn("alike", F.concat_ws(":", "direction", "expected", "from_day"))
    seen = kept(_single(near.select("left_id", "direction", "cell", "alike", "right_id", "n")).join(order, "left_id"), "fx-near")
    return strict.unionByName(_edges(_claims(seen.join(_islands(seen), ["direction", "cell"])), "fx"))


def _islands(seen: DataFrame) -> DataFrame:
    """(direction, cell, zone): cells of entries in a row have one zone.

    Entries of cells three or more apart can't see one row, so islands part where two cells in a row are missing. Each
    cell points to the one before it and the pointers are followed twice as far each time, by joins, so no order is made.
    """
    cells = kept(seen.select("direction", "cell").distinct(), "cells")
    back = lambda k: cells.select("direction", (F.col("cell") + k).alias("cell"), F.lit(k).alias(f"by{k}"))
    near = cells.join(back(1), ["direction", "cell"], "left").join(back(2), ["direction", "cell"], "left")
    at = kept(near.select("direction", "cell", (F.col("cell") - F.coalesce("by1", "by2", F.lit(0))).alias("to")), "islands")
    while True:
        far = at.select("direction", F.col("cell").alias("to"), F.col("to").alias("further"))
        step = kept(at.join(far, ["direction", "to"]).select("direction", "cell", F.col("further").alias("to"), (F.col("to") != F.col("further")).alias("moved")), "islands")
        at = step.select("direction", "cell", "to")
        if step.filter("moved").isEmpty():
            return at.select("direction", "cell", F.concat_ws(":", "direction", "to").alias("zone"))


def told(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """``described`` with ``reason``, the evidence behind each match in words; edges are put together by match once for all of it."""
    known = edges.join(rows.select("txn_id", "source", "external_ref", "amount_minor", "currency", "direction", "value_date", "group_ref"), "txn_id")
    # After that join no two edges of a match lie together, so they are dealt before they are sorted; nothing is dealt that no reason of their pass names.
    of = lambda s, c, *passes: F.when((F.col("side") == s) & (F.col("pass").isin(*passes) if passes else F.lit(True)), F.col(c))
    rule = ("economic_pair", "fx")
    asked = {
        "on_left": of("left", "txn_id").isNotNull(), "total": of("left", "amount_minor", "fx"), "source": of("left", "source", "parent_ref"), "currency": of("left", "currency", *rule),
        "direction": of("left", "direction", "economic_pair"), "booked": of("left", "value_date", "economic_pair"), "group_ref": of("left", "group_ref", "group_ref"),
        "ref": of("right", "external_ref", "parent_ref"), "amount": of("right", "amount_minor"), "paid": of("right", "value_date", "economic_pair"), "right_id": of("right", "txn_id"),
    }
    dealt = known.select("match_id", "pass", *(c.alias(name) for name, c in asked.items())).repartition("match_id")
    one = dealt.groupBy("match_id", "pass").agg(
        F.count_if("on_left").alias("n"), F.count("right_id").alias("n_right"), F.sum("total").alias("total"), *(F.min(c).alias(c) for c in ("source", "currency", "direction", "booked", "group_ref", "ref", "amount", "paid", "right_id")),
    )
    text = (
        F.when(F.col("pass") == "parent_ref", F.concat(F.lit("exact: the "), "source", F.lit(" row names gl entry "), "ref"))
        .when(F.col("pass") == "group_ref", F.concat(F.lit("exact: "), F.col("n").cast("string"), F.lit(" lines of "), "group_ref", F.lit(" add up to the bank's "), F.col("amount").cast("string")))
        .when(F.col("pass") == "economic_pair", F.concat(F.lit("rule: "), F.col("amount").cast("string"), F.lit(" "), "currency", F.lit(" "), "direction", F.lit(", same party, T+"), F.datediff("paid", "booked").cast("string")))
        .otherwise(F.concat(F.lit("rule: "), F.col("total").cast("string"), F.lit(" "), "currency", F.lit(" is "), fx_to_inr(F.col("total"), F.col("currency")).cast("string"), F.lit(" INR, the bank has "), F.col("amount").cast("string")))
    )
    return _kinds(one.select("match_id", "pass", F.col("n").alias("n_left"), "n_right", "right_id", text.alias("reason")), "right_id", "reason")


def reasons(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(match_id, reason): the evidence behind each match, in words."""
    return told(edges, rows).select("match_id", "reason")


def _kinds(sizes: DataFrame, *more: str) -> DataFrame:
    """Matches with their sizes, and with their tier and confidence, which are their pass's."""
    kinds = F.create_map(*[x for k, (t, c) in PASSES.items() for x in (F.lit(k), F.struct(F.lit(t).alias("tier"), F.lit(c).cast("double").alias("confidence")))])
    kind = kinds[F.col("pass")]
    one_to_many = (F.col("n_left") > 1) | (F.col("n_right") > 1)
    return sizes.select("match_id", "pass", kind["tier"].alias("tier"), kind["confidence"].alias("confidence"), "n_left", "n_right", one_to_many.alias("one_to_many"), *more)


def _sizes(edges: DataFrame, *more: Column) -> DataFrame:
    return edges.groupBy("match_id", "pass").agg(F.count_if(F.col("side") == "left").alias("n_left"), F.count_if(F.col("side") == "right").alias("n_right"), *more)


def describe(edges: DataFrame) -> DataFrame:
    """One row for each match: pass, tier, confidence and side sizes."""
    return _kinds(_sizes(edges))


def described(edges: DataFrame) -> DataFrame:
    """``describe`` with ``right_id``, the match's one right-hand side."""
    return _kinds(_sizes(edges, F.min(F.when(F.col("side") == "right", F.col("txn_id"))).alias("right_id")), "right_id")


def violations(edges: DataFrame) -> DataFrame:
    """Matches that break an invariant: an empty side, or an exact tier without certainty."""
    return describe(edges).filter("n_left = 0 OR n_right = 0 OR confidence NOT BETWEEN 0 AND 1 OR (tier = 'exact' AND confidence < 0.999)")


def tier_breakdown(edges: DataFrame) -> DataFrame:
    """Distinct records by their strongest tier, absent tiers with 0."""
    from ..schema import TIERS

    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    tiers = {k: t for k, (t, _) in PASSES.items()}
    tier = F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])[F.col("pass")]
    best = edges.withColumn("tier", tier).groupBy("txn_id").agg(F.min(rank).alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    names = edges.sparkSession.createDataFrame([(t, i + 1) for i, t in enumerate(TIERS)], "tier string, r int")
    return names.join(F.broadcast(best), "r", "left").select("tier", F.coalesce("n", F.lit(0)).alias("records"))  # at most one row for each tier


def blocking_stats(rows: DataFrame) -> DataFrame:
    """Buckets of (currency, direction, date, band) on the bank side: how many, and the largest."""
    keys = ["currency", "direction", "value_date", band(F.col("amount_minor"), BAND).alias("band")]
    return rows.filter("source = 'bank'").groupBy(*keys).count().agg(F.count(F.lit(1)).alias("buckets"), F.max("count").alias("largest"))
