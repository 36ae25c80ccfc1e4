"""The seeded shuffle: a bijection of any n, one order on any partitioning, files that are ranges of places."""

import pytest
from pyspark.errors import PySparkException

from closebook.operators import shuffle
from closebook.plans import generator


def plain(x, n, seed):
    """The network written as a loop."""
    a, b = shuffle.sides(n)
    while True:
        l, r = divmod(x, b)
        for turn, (p, q, s) in enumerate(shuffle.keys(seed)):
            u = (p * (l if turn % 2 else r) + q) % shuffle.PRIME
            moved = u * ((u + s) % shuffle.PRIME) % shuffle.PRIME
            l, r = (l, (r + moved) % b) if turn % 2 else ((l + moved) % a, r)
        x = l * b + r
        if x < n:
            return x


def places(spark, n, seed=shuffle.SEED, parts=None):
    return [r[0] for r in shuffle.placed(spark.range(0, n, 1, parts), "id", seed, n).orderBy("id").select("place").collect()]


def test_a_bijection_of_any_n(spark):
    for n in (1, 2, 3, 4, 5, 7, 10, 37, 101, 1000, 4099, 20_000):
        got = places(spark, n, 7)
        assert sorted(got) == list(range(n))
        assert got == [plain(x, n, 7) for x in range(n)]


def test_large_domains(spark):
    for n in (shuffle.MOST, shuffle.MOST - 12345, 10**15 + 1):
        ids = spark.createDataFrame([(x,) for x in (0, 1, n // 2, n - 1)], "id long")
        assert {r.id: r.place for r in shuffle.placed(ids, "id", 3, n).collect()} == {x: plain(x, n, 3) for x in (0, 1, n // 2, n - 1)}
    for n in (0, -1, shuffle.MOST + 1):
        with pytest.raises(ValueError):
            shuffle.sides(n)


def test_partitionings_and_seeds(spark):
    one = places(spark, 5000, 1, 1)
    assert one == places(spark, 5000, 1, 17) and one != places(spark, 5000, 2, 1)
    assert "Exchange" not in shuffle.placed(spark.range(50), "id", n=50)._jdf.queryExecution().executedPlan().toString()


def test_the_order_looks_random(spark):
    n = 20_000
    got = places(spark, n)
    ups = sum(x < y for x, y in zip(got, got[1:]))
    assert abs(ups / n - 0.5) < 0.02 and sum(x == i for i, x in enumerate(got)) < 12
    mean = (n - 1) / 2
    assert abs(sum((i - mean) * (x - mean) for i, x in enumerate(got)) / sum((i - mean) ** 2 for i in range(n))) < 0.03
    # Each tenth of the rows is spread over each tenth of the places.
    cells = [[0] * 10 for _ in range(10)]
    for i, x in enumerate(got):
        cells[i * 10 // n][x * 10 // n] += 1
    assert all(130 < c < 270 for row in cells for c in row)


def test_files_are_ranges_of_places(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 5).selectExpr("id * 3 AS id", "id % 7 AS place", "concat('r', id) AS text")
    for parts, name in ((1, "one"), (9, "nine")):
        assert shuffle.write(rows.repartition(parts), "id", f"{tmp_path}/{name}", 6) == -(-8998 // 6)
    read = [[tuple(r) for f in sorted((tmp_path / name).glob("part-*")) for r in spark.read.parquet(str(f)).collect()] for name in ("one", "nine")]
    assert read[0] == read[1] and [r[0] for r in read[0]] == sorted((x * 3 for x in range(3000)), key=lambda x: plain(x, 8998, shuffle.SEED))
    sizes = [spark.read.parquet(str(f)).count() for f in (tmp_path / "nine").glob("part-*")]
    assert len(sizes) == 6 and min(sizes) > 400 and set(read[0]) == {tuple(r) for r in rows.collect()}


def test_odd_numbers(spark):
    ids = spark.createDataFrame([(None,), (3,), (3,)], "id long")
    got = {r.id: r.place for r in shuffle.placed(ids, "id").collect()}
    assert got[None] is None and 0 <= got[3] < 4
    assert shuffle.placed(ids.limit(0), "id").collect() == []
    for bad, n in ((-1, 5), (5, 5)):
        with pytest.raises(PySparkException):
            shuffle.placed(spark.createDataFrame([(bad,)], "id long"), "id", n=n).collect()


def test_a_shuffled_batch(spark):
    plain_, mixed = generator.generate(spark, 300, seed=5), generator.generate(spark, 300, seed=5, shuffled=True)
    told = lambda b: sorted(map(str, b.rows.drop("seq").collect()))
    assert told(plain_) == told(mixed) and mixed.rows.select("seq").distinct().count() == mixed.rows.count()
    by_arrival = [r[0] for r in mixed.rows.orderBy("seq").select("external_ref").collect()]
    assert by_arrival != [r[0] for r in plain_.rows.orderBy("seq").select("external_ref").collect()]
