"""What is counted, and how long it took, while a table is written: no second job reads it again."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation

from ..storage import kept


@dataclass
class Measured:
    """A written table, the counts that came with the write, and its seconds."""

    rows: DataFrame
    counts: dict[str, int]
    seconds: float

    @property
    def per_second(self) -> float:
        return next(iter(self.counts.values())) / self.seconds


def measured(df: DataFrame, label: str, by: str | None = None, **counts: Column) -> Measured:
    """Write ``df`` as a table and observe ``counts``, aggregates over its rows, on the way.

    The observation lies directly under the write, in the stage whose tasks commit: each task's counts are taken once,
    also where a task is tried again or an executor is lost.
    """
    seen, began = Observation(), time.monotonic()
    rows = kept(df.observe(seen, *(c.alias(name) for name, c in counts.items())), label, by)
    took = time.monotonic() - began
    return Measured(rows, {name: seen.get.get(name) or 0 for name in counts}, took)
