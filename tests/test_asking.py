"""Sessions that ask at once all get their entries into the log."""

from concurrent.futures import ThreadPoolExecutor

from closebook.streaming.keyed import KeyedLog

ENTRY = "phase int, decision string, actor string, subjects array<string>, reason string, confidence double, tier string, amount_minor long, currency string, candidate int, idempotency_key string"


def test_asks_at_once_are_all_kept(spark, tmp_path):
    for k in range(6):
        path = f"file://{tmp_path}/log{k}"
        logs = [KeyedLog(s, path) for s in (spark, spark.newSession(), spark.newSession(), spark.newSession())]

        def ask(i, logs=logs):
            rows = [(8, "d", "a", ["s"], f"{i}", None, None, 1, "INR", None, f"k{i}.{j}") for j in range(4)]
            logs[i].write(logs[i].spark.createDataFrame(rows, ENTRY).repartition(4))

        with ThreadPoolExecutor(4) as pool:
            list(pool.map(ask, range(4)))
        logs[0].start(f"file://{tmp_path}/marks{k}").awaitTermination()
        assert sorted(r.idempotency_key for r in logs[0].read().collect()) == [f"k{i}.{j}" for i in range(4) for j in range(4)]
