"""Hand rows for every pass, exception and function."""

import datetime

import pytest
from pyspark.sql import functions as F

from closebook.functions import money, text
from closebook.operators import exceptions, forecast, ingest, matching, serving
from closebook.operators.access import BadCandidate, Denied, NotFound, Principal, Resolutions, Tokens
from closebook.plans.close import Close
from closebook.schema import CANONICAL
from closebook.sources import feeds
from closebook.sources.sinks import JsonLog

DAY = datetime.date(2026, 8, 15)


def rows(spark, *specs):
    """Canonical rows from (source, ref, changes)."""
    made = []
    for i, (source, ref, more) in enumerate(specs):
        r = {"amount": 100_000, "currency": "INR", "direction": "inbound", "days": 0, "cp": None, "parent": None, "group": None} | more
        day = DAY + datetime.timedelta(days=r["days"])
        made.append((i, f"{source}:{ref}", source, ref, r["amount"], r["currency"], 0, 0, r["direction"], day, datetime.datetime.combine(day, datetime.time()), "settled", r["cp"], r["parent"], r["group"]))
    return spark.createDataFrame(made, CANONICAL)


def matches(edges):
    return edges.select("match_id").distinct().count()


def nothing(spark):
    return spark.createDataFrame([], "txn_id string")


def test_parent_ref_ignores_amount_and_needs_one_gl_row_of_the_currency(spark):
    one = rows(spark, ("gl", "o1", {}), ("settlement", "p1", {"amount": 98_000, "parent": "o1"}))
    assert matches(matching.parent_ref(one)) == 1
    assert matches(matching.parent_ref(one.unionByName(one.filter("source = 'gl'").withColumn("txn_id", F.lit("x"))))) == 0
    assert matches(matching.parent_ref(rows(spark, ("gl", "o1", {"currency": "USD"}), ("settlement", "p1", {"parent": "o1"})))) == 0
    assert matches(matching.parent_ref(rows(spark, ("gl", "", {}), ("settlement", "p1", {"parent": ""})))) == 0


def test_group_ref_confirms_the_sum(spark):
    lines = [("settlement", f"p{i}", {"group": "U1"}) for i in range(3)]
    good = matching.group_ref(rows(spark, ("bank", "U1", {"amount": 300_000}), *lines))
    assert matches(good) == 1 and good.filter("side = 'left'").count() == 3
    assert matches(matching.group_ref(rows(spark, ("bank", "U1", {"amount": 300_001}), *lines))) == 0
    assert matches(matching.group_ref(rows(spark, ("bank", "U1", {"amount": 300_000, "currency": "USD"}), *lines))) == 0
    assert matches(matching.group_ref(rows(spark, ("bank", "U1", {"amount": 300_000}), *[(s, r, {}) for s, r, _ in lines]))) == 0


def test_economic_pair(spark):
    pair = (("gl", "l1", {"cp": "Acme  Ltd "}), ("bank", "b1", {"cp": "ACME LTD", "days": 2}))
    for run in (matching.economic_pair, matching.economic_pair_greedy):
        assert matches(run(rows(spark, *pair), nothing(spark))) == 1
        assert matches(run(rows(spark, *pair, ("bank", "b2", {"cp": "acme ltd"})), nothing(spark))) == 0
        assert matches(run(rows(spark, ("gl", "l1", {}), ("bank", "b1", {"days": 3})), nothing(spark))) == 0
        assert matches(run(rows(spark, ("gl", "l1", {"days": 1}), ("bank", "b1", {})), nothing(spark))) == 0
        resolved = spark.createDataFrame([("bank:b1",)], "txn_id string")
        assert matches(run(rows(spark, *pair), resolved)) == 0


def test_greedy_depends_on_order_and_strict_does_not(spark):
    l1, l2, b1, b2 = ("gl", "l1", {"days": 0}), ("gl", "l2", {"days": 1}), ("bank", "b1", {"days": 2}), ("bank", "b2", {"days": 3})
    first, second = rows(spark, l1, l2, b1, b2), rows(spark, l2, l1, b1, b2)
    assert matches(matching.economic_pair_greedy(first, nothing(spark))) == 2
    assert matches(matching.economic_pair_greedy(second, nothing(spark))) == 1
    assert matches(matching.economic_pair(first, nothing(spark))) == matches(matching.economic_pair(second, nothing(spark))) == 0


def test_fx(spark):
    book = ("gl", "l1", {"currency": "USD", "amount": 100_000})
    for run in (matching.fx, matching.fx_greedy):
        assert matches(run(rows(spark, book, ("bank", "b1", {"amount": 8_320_100, "days": 2})), nothing(spark))) == 1
        assert matches(run(rows(spark, book, ("bank", "b1", {"amount": 8_320_101})), nothing(spark))) == 0
        assert matches(run(rows(spark, book, ("bank", "b1", {"amount": 8_320_000}), ("bank", "b2", {"amount": 8_319_950})), nothing(spark))) == 0
        assert matches(run(rows(spark, book, ("bank", "b1", {"amount": 8_320_000, "direction": "outbound"})), nothing(spark))) == 0


def test_lone_gl_row_has_no_counterpart(spark):
    close = Close(rows(spark, ("gl", "l1", {})))
    close.check()
    assert [(r.type, r.severity) for r in close.found.collect()] == [("no_counterpart", "high")]


@pytest.mark.parametrize("gap,confidence", [(0, 0.8), (1, 0.65)])
def test_double_payment(spark, gap, confidence):
    close = Close(rows(spark, ("settlement", "p1", {"group": "U1"}), ("bank", "U1", {"cp": "A"}), ("bank", "U2", {"cp": "a", "days": gap})))
    got = close.anomalies.collect()
    assert [(r.primary_id, r.twin_id, r.lag, r.confidence) for r in got] == [("bank:U2", "bank:U1", gap, confidence)]


def test_monthly_repeats_are_no_double_payments(spark):
    close = Close(rows(spark, ("settlement", "p1", {"group": "U1"}), ("bank", "U1", {"cp": "A"}), ("bank", "U2", {"cp": "A", "days": 30})))
    assert close.anomalies.count() == 0


def test_groupings_are_first_by_size_and_place(spark):
    lines = [("settlement", f"p{i}", {"amount": a, "cp": "A", "days": 1}) for i, a in enumerate((60, 40, 30, 10))]
    close = Close(rows(spark, ("bank", "U9", {"amount": 100, "cp": "a"}), *lines))
    got = close.groupings.orderBy("rank").collect()
    assert [r.line_ids for r in got] == [["settlement:p0", "settlement:p1"], ["settlement:p0", "settlement:p2", "settlement:p3"]]
    assert [r.confidence for r in got] == [0.6, 0.55]
    close.check()
    assert {r.category for r in close.found.collect()} == {"one_to_many", "settled_never_received"}


def test_dedupe_keeps_the_first_and_remembers(spark):
    twice = rows(spark, ("bank", "U1", {"amount": 1}), ("bank", "U1", {"amount": 2}))
    assert [r.amount_minor for r in ingest.dedupe(twice).collect()] == [1]
    assert ingest.dedupe(twice, twice.select("source", "external_ref")).count() == 0


def test_parsers_reject_skip_and_shift(spark):
    parsed = feeds.parse_all(feeds.planted_bad(spark))
    assert parsed.filter("outcome = 'reject'").count() == 15 and parsed.filter("outcome = 'skip'").count() == 1
    late = spark.createDataFrame([(1, "s", "p", None, "1,234.50", "", None, "inr", "", "2026-08-02T02:00:00+05:30", None, "x")], feeds.RAW["settlement"])
    r = feeds.parse_settlement(late).first()
    assert (r.outcome, r.value_date, r.amount_minor, r.fee_minor, r.group_ref) == ("ok", datetime.date(2026, 8, 1), 123_450, 0, None)
    short = spark.createDataFrame([(1, "2/8/2026", "2/8/2026", "NEFT CR-U1-ACME", "U1", "", "1,00,000.00", "")], feeds.RAW["bank"])
    r = feeds.parse_bank(short).first()
    assert (r.value_date, r.amount_minor, r.counterparty, r.direction) == (datetime.date(2026, 8, 2), 10_000_000, "ACME", "inbound")
    with pytest.raises(KeyError):
        feeds.parse_all({"fax": short})


def test_money(spark):
    df = spark.createDataFrame([("12.34",), ("12.340",), ("12.3400000001",), ("-5",), ("x",), (None,), ("1e3",)], "t string")
    assert [r[0] for r in df.select(money.to_minor(F.col("t"))).collect()] == [1234, 1234, None, -500, None, None, None]
    df = spark.createDataFrame([(12345678,), (99,), (100000000,), (123456,)], "m long")
    assert [r[0] for r in df.select(money.lakh_grouped(F.col("m"))).collect()] == ["1,23,456.78", "0.99", "10,00,000.00", "1,234.56"]
    assert [r[0] for r in spark.createDataFrame([(10_500,), (19_999,), (20_001,)], "m long").select(money.band(F.col("m"))).collect()] == [1, 1, 2]


def test_redaction(spark):
    said = ["NEFT CR JOHN SMITH", "NEFT CR", "acct 123456789012", "a@b.co or +91 9876543210", "NEFT CR paid ACME CORP", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "t string").select(text.redact(F.col("t"))).collect()]
    assert got == ["[NAME]", "NEFT CR", "acct [ACCT:9012]", "[EMAIL] or [PHONE]", "NEFT CR paid [NAME]", None]
    row = spark.sql("select 'x' as Party, 1 as n, named_struct('email', 'e', 'note', 'a@b.co') as s, array('a@b.co') as l, array(array('a@b.co')) as ll")
    r = text.redact_row(row).first()
    assert (r.Party, r.n, r.s.email, r.s.note, r.l, r.ll) == ("[REDACTED]", 1, "[REDACTED]", "[EMAIL]", ["[EMAIL]"], [["a@b.co"]])


def test_history_fills_days_and_excludes(spark):
    bank = rows(spark, ("bank", "a", {}), ("bank", "b", {"days": 4, "direction": "outbound", "cp": "Rent"}))
    got = forecast.history(bank).orderBy("day").collect()
    assert [(r.net, r.quiet) for r in got] == [(100_000, False), (0, True), (0, True), (0, True), (-100_000, False)]
    assert forecast.history(bank, exclude=("RENT",)).agg(F.sum("outflow")).first()[0] == 0
    assert forecast.history(bank.limit(0)).count() == 0


def test_constant_history_projects_without_width(spark):
    flows = spark.sql("select date_add(date'2026-01-01', int(id)) as day, bigint(10) as net from range(20)")
    booked = spark.createDataFrame([("x", DAY + datetime.timedelta(days=2), 5, "booked")], "label string, due_date date, amount_minor long, certainty string")
    got = forecast.project(flows, DAY, 5, 100, booked, simulations=50).orderBy("day").collect()
    assert [(r.p10, r.p50, r.p90) for r in got] == [(x, x, x) for x in (110, 120, 125, 135, 145)]
    with pytest.raises(ValueError):
        forecast.project(flows.limit(5), DAY, 5, 100)
    with pytest.raises(ValueError):
        forecast.project(flows, DAY, 5, 100, booked.withColumn("amount_minor", F.lit(-1).cast("long")))


def test_nearest_rank_rounds_half_to_even(spark):
    paths = spark.sql("select 1 as k, id as v from range(1, 26)")
    r = forecast.nearest_rank(paths, ["k"], "v", 25).first()
    assert (r.p10, r.p50, r.p90) == (2, 12, 22)


def test_pages_neither_skip_nor_repeat(spark):
    table = rows(spark, *[("bank", f"U{i:02d}", {}) for i in range(25)])
    seen, after = [], None
    while page := [r.txn_id for r in serving.transactions_page(table, after=after, limit=10).collect()]:
        seen, after = seen + page, page[-1]
    assert seen == [f"bank:U{i:02d}" for i in range(25)]
    assert serving.transactions_page(table, source="fax").count() == 0
    with pytest.raises(serving.BadPage):
        serving.transactions_page(table, limit=0)


def test_access_and_resolutions(spark):
    close = Close(rows(spark, ("gl", "l1", {})))
    desk = Resolutions(close.found, close.groupings)
    viewer, controller = Principal("v", "viewer"), Principal("c", "controller")
    with pytest.raises(NotFound):
        desk.resolve("nope", viewer, "n")
    with pytest.raises(Denied):
        desk.resolve("gl:l1", viewer, "n")
    with pytest.raises(BadCandidate):
        desk.resolve("gl:l1", controller, "n", candidate=0)
    first, again = desk.resolve("gl:l1", controller, "n", key="k"), desk.resolve("gl:l1", controller, "other", key="k")
    assert (first["replayed"], again["replayed"]) == (False, True) and first | {"replayed": True} == again
    assert [(r.actor, r.amount_minor, r.currency, r.reason) for r in desk.log.read().collect()] == [("human:c", 100_000, "INR", "resolved by controller: n")]
    with pytest.raises(Denied):
        desk.resolve("gl:l1", viewer, "n", key="k")
    assert Principal("x", "admin").permissions == controller.permissions and not Principal("x", "nobody").permissions
    tokens = Tokens()
    tokens.add("a" * 16, viewer)
    assert tokens.find("a" * 16) == viewer and tokens.find("b" * 16) is None
    with pytest.raises(ValueError):
        tokens.add("short", viewer)


def test_resolutions_survive_their_session(spark, tmp_path):
    close = Close(rows(spark, ("gl", "l1", {})))
    log = JsonLog(spark, str(tmp_path / "decisions"))
    assert len(log) == 0
    Resolutions(close.found, close.groupings, log).resolve("gl:l1", Principal("c", "controller"), "n", key="k")
    again = Resolutions(close.found, close.groupings, JsonLog(spark, str(tmp_path / "decisions"))).resolve("gl:l1", Principal("c", "controller"), "m", key="k")
    assert again["replayed"] and again["reason"] == "resolved by controller: n" and len(log) == 1


def test_cursors_walk_every_list(spark):
    close = Close(rows(spark, *[("gl", f"l{i:02}", {"amount": 100 * (1 + i % 3)}) for i in range(7)]))
    seen, cursor = [], None
    while True:
        page = serving.page(close.found, "exceptions", cursor, limit=3)
        seen += [r.subject_id for r in page.items]
        if (cursor := page.next) is None:
            break
    assert seen == [r.subject_id for r in sorted(close.found.collect(), key=lambda r: (-r.at_risk, r.subject_id))] and len(seen) == 7
    entries = spark.createDataFrame([(p, "d", ["s"], r) for p in (1, 2) for r in ("a", None)], "phase int, decision string, subjects array<string>, reason string")
    first = serving.page(serving.audit_list(entries), "audit", limit=3)
    assert [(r.phase, r.reason) for r in serving.page(serving.audit_list(entries), "audit", first.next).items] == [(2, "a")]
    with pytest.raises(serving.BadPage):
        serving.page(close.found, "exceptions", "nonsense")
    assert serving.exception(close.found, "gl:l03").at_risk == 100 and serving.exception(close.found, "gl:x") is None


def test_greedy_equals_a_plain_replay(spark):
    """Claims in list order over all unresolved rows, one after another, as the passes are described."""
    import random

    for seed in range(3):
        rng = random.Random(seed)
        specs = [(rng.choice(["gl", "bank"]), f"r{i}", {"amount": rng.choice([100, 200]), "days": rng.randrange(8), "cp": rng.choice("ab")}) for i in range(60)]
        specs += [("gl", f"f{i}", {"currency": "USD", "amount": 1000 + rng.randrange(6), "days": rng.randrange(5)}) for i in range(15)]
        specs += [("bank", f"g{i}", {"amount": 83_200 + rng.randrange(500), "days": rng.randrange(7), "cp": "z"}) for i in range(15)]
        table = rows(spark, *specs)
        held = [r.asDict() for r in table.orderBy("seq").collect()]
        days = lambda a, b: (b["value_date"] - a["value_date"]).days

        def replay(book, bank, near):
            taken, out = set(), set()
            for e in book:
                free = [b["txn_id"] for b in bank if b["txn_id"] not in taken and 0 <= days(e, b) <= 2 and e["direction"] == b["direction"] and near(e, b)]
                if len(free) == 1:
                    taken.add(free[0])
                    out |= {(e["txn_id"], free[0])}
            return out

        def pairs(edges):
            sides = {}
            for r in edges.collect():
                sides.setdefault(r.match_id, {})[r.side] = r.txn_id
            return {(x["left"], x["right"]) for x in sides.values()}

        same = lambda e, b: (e["currency"], e["amount_minor"], e["counterparty"]) == (b["currency"], b["amount_minor"], b["counterparty"])
        book, bank = ([r for r in held if r["source"] == s] for s in ("gl", "bank"))
        assert pairs(matching.economic_pair_greedy(table, nothing(spark))) == replay(book, bank, same)
        foreign = [e | {"expected": round(e["amount_minor"] * 83.2)} for e in book if e["currency"] != "INR"]
        assert pairs(matching.fx_greedy(table, nothing(spark))) == replay(foreign, bank, lambda e, b: abs(b["amount_minor"] - e["expected"]) <= 100)


def test_audit_log_appends(spark, tmp_path):
    log = JsonLog(spark, str(tmp_path / "log"))
    entry = spark.sql("select 0 as phase, 'batch_started' as decision, 'p' as actor, array('bank:U1') as subjects, 'r' as reason, cast(null as double) as confidence, cast(null as string) as tier, 1L as amount_minor, 'INR' as currency")
    log.write(entry)
    log.write(entry)
    assert len(log) == 2
    line = spark.read.text(str(tmp_path / "log")).first()[0]
    assert "confidence" not in line and '"amount_minor":1' in line


def test_streaming_dedupe_accepts_once(spark, tmp_path):
    from closebook.streaming.dedupe import AcceptedTable, within_watermark

    source = str(tmp_path / "in")
    rows(spark, ("bank", "U1", {}), ("bank", "U2", {})).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(CANONICAL).json(source)
    table = AcceptedTable(spark, str(tmp_path / "out"))
    table.start(stream, str(tmp_path / "cp")).awaitTermination()
    rows(spark, ("bank", "U2", {}), ("bank", "U3", {})).coalesce(1).write.mode("append").json(source)
    table.start(spark.readStream.schema(CANONICAL).json(source), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.external_ref for r in table.read().collect()) == ["U1", "U2", "U3"]
    assert within_watermark(stream).isStreaming
