"""Two sessions that decide under one key, replays, and a batch that is run again: one entry."""

from concurrent.futures import ThreadPoolExecutor

from closebook.operators.access import Principal, Resolutions
from closebook.streaming.keyed import KeyedLog


def test_one_entry_for_a_key(spark, tmp_path):
    found = spark.createDataFrame([("gl:1", 100, "INR"), ("gl:2", 50, "INR")], "subject_id string, at_risk long, currency string")
    groups = spark.createDataFrame([], "deposit_id string")
    path, marks = f"file://{tmp_path}/log", f"file://{tmp_path}/marks"
    sessions = [Resolutions(found, groups, KeyedLog(s, path)) for s in (spark, spark.newSession())]
    people = [Principal("ann", "reviewer"), Principal("bob", "reviewer")]
    with ThreadPoolExecutor(2) as pool:  # neither sees the other's
        both = list(pool.map(lambda k: sessions[k].resolve("gl:1", people[k], f"by {k}", key="k1"), range(2)))
    assert not any(x["replayed"] for x in both)
    log = KeyedLog(spark, path)
    log.start(marks).awaitTermination()
    applied = log.read().collect()
    assert len(applied) == 1 and applied[0].idempotency_key == "k1"
    # Later calls are answered by the winner, in either session.
    again = [s.resolve("gl:1", people[k], "again", key="k1") for k, s in enumerate(sessions)]
    assert all(x["replayed"] and x["actor"] == applied[0].actor and x["reason"] == applied[0].reason for x in again)
    # One that asks late, entries without keys, and the same batch once more.
    entry = log.spark.createDataFrame([r.asDict() for r in applied], log.read().schema)
    log.write(entry, "a late one")
    sessions[0].resolve("gl:2", people[0], "no key")
    sessions[0].resolve("gl:2", people[0], "no key")
    log.start(marks).awaitTermination()
    assert sorted(r.idempotency_key or "" for r in log.read().collect()) == ["", "", "k1"]
    batch = spark.read.schema("phase int, decision string, actor string, subjects array<string>, reason string, confidence double, tier string, amount_minor long, currency string, candidate int, idempotency_key string, asked string").json(f"{path}/asked")
    before = sorted(map(str, log.read().collect()))
    log.apply_batch(batch.filter("idempotency_key = 'k1' AND asked NOT LIKE 'a late one%'"), 0)  # the first batch, run again
    assert sorted(map(str, log.read().collect())) == before
    winner = KeyedLog(spark.newSession(), path).read().filter("idempotency_key = 'k1'").collect()
    assert len(winner) == 1 and winner[0].actor == applied[0].actor


def test_smallest_writer_wins_and_nothing_is_read_before(spark, tmp_path):
    log = KeyedLog(spark, f"file://{tmp_path}/log")
    assert log.read().count() == 0
    one = lambda reason: spark.createDataFrame([(8, "d", "a", ["s"], reason, None, None, 1, "INR", None, "k")], "phase int, decision string, actor string, subjects array<string>, reason string, confidence double, tier string, amount_minor long, currency string, candidate int, idempotency_key string")
    for name in ("m", "c", "x"):
        log.write(one(name), name)
    log.start(f"file://{tmp_path}/marks").awaitTermination()
    assert [r.reason for r in log.read().collect()] == ["c"]
