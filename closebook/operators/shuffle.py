"""A seeded shuffle: each row's place from its own number, without looking at any other row.

A keyed Feistel network permutes the numbers below n: a number is a cell of an a by b grid with a * b >= n, and each
round moves one coordinate by a function of the other. A cell beyond n goes through the network again until it falls
below n, so the whole is a bijection of 0 .. n - 1 for any n. The order is that of the places: it is the same over any
partitioning, a lost task finds the same places again, and a file of the result is a range of places, dealt by
arithmetic and sorted by itself. Nothing is sorted as a whole and nothing is sampled.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, PRIME, SEED = 6, (1 << 31) - 1, 42
#: Numbers stay below this, so that no product leaves 64 bits.
MOST = 1 << 62
#: Passes through the network; a grid has fewer than sqrt(n) cells too many, so a row needs a third one with a chance of 1 / n.
WALKS = 64
OUTSIDE = "raise_error('a number to be shuffled is negative or too large')"


def sides(n: int) -> tuple[int, int]:
    """a and b with a * b >= n and fewer than a cells to spare."""
    if not 0 < n <= MOST:
        raise ValueError(f"a shuffle is of 1 to {MOST} numbers")
    a = math.ceil(math.sqrt(n))
    return a, -(-n // a)


def keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers below the prime for each round."""
    drawn = (hashlib.md5(f"{seed}:{r}".encode()).hexdigest() for r in range(ROUNDS))
    return [tuple(1 + int(h[8 * i : 8 * i + 8], 16) % (PRIME - 1) for i in range(3)) for h in drawn]


def _mixed(x: str, c: str) -> str:
    """A number below the prime from x and a round's key: one linear step and one quadratic."""
    u = f"(({c}a * {x} + {c}b) % {PRIME})"
    return f"(({u} * (({u} + {c}c) % {PRIME})) % {PRIME})"


def place(x: str, n: int, seed: int = SEED) -> Column:
    """The place of a number below ``n``, given as an expression; null of null, an error of a number outside."""
    a, b = sides(n)
    rounds = ", ".join(f"named_struct('odd', {str(bool(r % 2)).lower()}, 'a', {k[0]}L, 'b', {k[1]}L, 'c', {k[2]}L)" for r, k in enumerate(keys(seed)))

    def once(v: str) -> str:
        moved = f"if(c.odd, named_struct('l', s.l, 'r', (s.r + {_mixed('s.l', 'c.')}) % {b}L), named_struct('l', (s.l + {_mixed('s.r', 'c.')}) % {a}L, 'r', s.r))"
        return f"aggregate(array({rounds}), named_struct('l', {v} div {b}L, 'r', {v} % {b}L), (s, c) -> {moved}, s -> s.l * {b}L + s.r)"

    number = f"CAST({x} AS bigint)"
    if walks := min(a * b - n, WALKS):
        found = f"aggregate(sequence(1, {walks}), {once(number)}, (v, i) -> if(v < {n}L, v, {once('v')}), v -> if(v < {n}L, v, raise_error('no place was found')))"
    else:
        found = once(number)
    return F.expr(f"CASE WHEN {number} IS NULL THEN NULL WHEN {number} BETWEEN 0L AND {n - 1}L THEN {found} ELSE {OUTSIDE} END")


def bound(df: DataFrame, by: str) -> int:
    """One more than the largest number; 1 of an empty table."""
    return (df.agg(F.max(F.col(f"`{by}`").cast("bigint"))).first()[0] or 0) + 1


def placed(df: DataFrame, by: str, seed: int = SEED, n: int | None = None, name: str = "place") -> DataFrame:
    """``df`` with each row's place. ``by`` names unique numbers from 0; they may have gaps, and places then have gaps too.

    Rows with one number share a place; a row without a number has none. A column called ``name`` is replaced.
    """
    n = n or bound(df, by)
    a, b = sides(n)
    if a * b > n:
        return df.withColumn(name, place(f"`{by}`", n, seed))
    # No cell is beyond n, so there is nothing to walk: each round is two columns of plain arithmetic, which is compiled, as a fold over the rounds is not.
    number = f"CAST(`{by}` AS bigint)"
    moved = df.withColumn("_n", F.expr(f"CASE WHEN {number} BETWEEN 0L AND {n - 1}L THEN {number} WHEN {number} IS NOT NULL THEN {OUTSIDE} END"))
    moved = moved.withColumns({"_l": F.expr(f"_n div {b}L"), "_r": F.expr(f"_n % {b}L")})
    for r, k in enumerate(keys(seed)):
        side, other, width = ("_r", "_l", b) if r % 2 else ("_l", "_r", a)
        moved = moved.withColumn("_u", F.expr(f"({k[0]}L * {other} + {k[1]}L) % {PRIME}L"))
        moved = moved.withColumn(side, F.expr(f"({side} + (_u * ((_u + {k[2]}L) % {PRIME}L)) % {PRIME}L) % {width}L"))
    return moved.withColumn(name, F.expr(f"_l * {b}L + _r")).drop("_n", "_l", "_r", "_u")


def write(df: DataFrame, by: str, path: str, files: int, seed: int = SEED, n: int | None = None) -> int:
    """Write ``df`` in shuffled order as ``files`` files, each a range of equally many places; returns that width.

    Places are spread evenly also where the numbers are not, so files are of like sizes. Rows without a number go first.
    """
    n = n or bound(df, by)
    width = -(-n // files)
    order = "place" if "place" not in df.columns else "_place"
    dealt = placed(df, by, seed, n, order).repartitionById(files, F.coalesce(F.expr(f"CAST({order} div {width}L AS int)"), F.lit(0)))
    dealt.sortWithinPartitions(F.asc_nulls_first(order)).drop(order).write.parquet(path)
    return width


def places_sql(ids: str, n: str, seed: int = SEED) -> str:
    """CTEs ending in placed(k, place), in DuckDB's SQL, for ``WITH RECURSIVE``: the network round by round, again from the first beyond n.

    ``ids`` has a column k of numbers below the scalar expression ``n``.
    """
    rounds = ", ".join(f"({r}, {', '.join(f'CAST({x} AS BIGINT)' for x in k)})" for r, k in enumerate(keys(seed)))
    return f"""
grid AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT CAST({n} AS BIGINT) AS n))),
turn(turn, a, b, c) AS (VALUES {rounds}),
walk AS (SELECT k, k // b AS l, k % b AS r, 0 AS turn FROM (SELECT CAST(k AS BIGINT) AS k FROM {ids}), grid
         UNION ALL
         SELECT w.k, CASE WHEN w.turn % 2 = 0 THEN (w.l + {_mixed('w.r', 't.')}) % g.a ELSE w.l END, CASE WHEN w.turn % 2 = 1 THEN (w.r + {_mixed('w.l', 't.')}) % g.b ELSE w.r END, w.turn + 1
         FROM (SELECT k, l, r, CASE WHEN turn = {ROUNDS} THEN 0 ELSE turn END AS turn FROM walk, grid WHERE turn < {ROUNDS} OR l * b + r >= n) w JOIN turn t USING (turn), grid g),
placed AS (SELECT k, l * b + r AS place FROM walk, grid WHERE turn = {ROUNDS} AND l * b + r < n)"""
