"""Claims in rounds against a plain replay: one key with a third of all rows, dense converted amounts, chains, ties."""

import random

import pytest

from closebook.operators import matching


def replay(pairs):
    """Entries in order of (seq, left_id), each taking its only free row."""
    sees, taken, out = {}, set(), set()
    for left, seq, _, _, right in pairs:
        sees.setdefault((seq, left), set()).add(right)
    for (_, left), rights in sorted(sees.items()):
        free = rights - taken
        if len(free) == 1:
            taken |= free
            out.add((left, *free))
    return out


def claimed(spark, pairs):
    table = spark.createDataFrame(pairs, "left_id string, seq long, alike string, zone string, right_id string")
    return {tuple(r) for r in matching._claims(table).collect()}


def by_days(rng, entries, days, zone, first_seq=0):
    """Entries of one key in mixed order of days; each day has a row or none; an entry sees its own day and two more."""
    rows = {d: f"{zone}b{d}" for d in range(days) if rng.random() < 0.8}
    out = []
    for i in range(entries):
        day = rng.randrange(days)
        out += [(f"{zone}e{i}", first_seq + i, f"{zone}{day}", zone, rows[d]) for d in range(day, day + 3) if d in rows]
    return out


def test_one_key_with_a_third_of_all_rows(spark):
    rng = random.Random(1)
    pairs = by_days(rng, 3000, 28, "hot")
    for k in range(600):
        pairs += by_days(rng, 10, 6, f"k{k}")
    assert claimed(spark, pairs) == replay(pairs)


@pytest.mark.parametrize("seed", range(3))
def test_dense_amounts(spark, seed):
    """Entries at close amounts in one zone, each seeing all rows within a tolerance; some entries alike, seqs tied."""
    rng = random.Random(seed)
    rows = {f"b{i}": rng.randrange(400) for i in range(120)}
    pairs = []
    for i in range(250):
        amount, place = rng.randrange(400), rng.randrange(3) if seed == 2 else i
        pairs += [(f"e{i}", place, str(amount), "z", b) for b, at in rows.items() if abs(at - amount) <= 3]
    assert claimed(spark, pairs) == replay(pairs)


def test_chains_and_nothing(spark):
    chain = [(f"e{i:02d}", i, f"a{i}", "z", f"b{j:02d}") for i in range(12) for j in ((i - 1, i) if i else (0,))]
    assert claimed(spark, chain) == replay(chain) and len(replay(chain)) == 12
    assert claimed(spark, []) == set()


def test_no_python_and_no_window_by_key(spark):
    rows = spark.createDataFrame([(f"e{i}", i, "a", "z", "b") for i in range(5)], "left_id string, seq long, alike string, zone string, right_id string")
    assert "Python" not in matching._claims(rows)._jdf.queryExecution().executedPlan().toString()


def test_islands_part_where_rows_cannot_meet(spark):
    cells = [("in", c) for c in [1, 2, 4, 7, 8, 20, *range(30, 100)]] + [("out", 2)]
    got = {(r.direction, r.cell): r.zone for r in matching._islands(spark.createDataFrame(cells, "direction string, cell long")).collect()}
    assert len(got) == len(cells) and len({got["in", c] for c in (1, 2, 4)}) == 1 and len({got["in", c] for c in range(30, 100)}) == 1
    assert len(set(got.values())) == 5
