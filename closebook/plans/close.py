"""A month-end close over a table of transactions, stage by stage; each stage is made once."""

from __future__ import annotations

from functools import cached_property

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exceptions, ingest, matching, metrics, scoring
from ..schema import COLUMNS
from ..storage import kept, unfolded, union_all
from . import workload

#: What is read of a record that the exact passes leave.
OPEN = ["seq", "txn_id", "source", "external_ref", "amount_minor", "currency", "direction", "value_date", "counterparty"]


class Close:
    """Rows as they arrived in, matches and exceptions out.

    What several stages read is written to the shared folder once and read back, so that plans stay small
    and a lost executor costs its own tasks only.
    """

    def __init__(self, arrived: DataFrame, greedy: bool = False):
        """``greedy``: the two economic passes claim in list order, also where keys are contested."""
        self.arrived, self.greedy = arrived, greedy
        #: Stages of the reconciliation with their number of rows and seconds, as they were written.
        self.measured: dict[str, metrics.Measured] = {}

    def _measure(self, df: DataFrame, label: str, by: str | None = None) -> DataFrame:
        self.measured[label] = metrics.measured(df, label, by, n=F.count(F.lit(1)))
        return self.measured[label].rows

    @cached_property
    def feed(self) -> DataFrame:
        return kept(self.arrived, "feed", by="source")

    @cached_property
    def rows(self) -> DataFrame:
        feed = self.feed
        return self._measure(ingest.dedupe(feed), "rows", by="source")

    @cached_property
    def exact(self) -> DataFrame:
        return self._measure(matching.parent_ref(self.rows).unionByName(matching.group_ref(self.rows)), "exact")

    @cached_property
    def free(self) -> DataFrame:
        """What the exact passes leave: all rows are held against matches this once, the later passes read these few only."""
        return self._measure(self.rows.select(*OPEN).join(self.exact.select("txn_id"), "txn_id", "left_anti"), "free")

    @cached_property
    def economic(self) -> DataFrame:
        run = matching.economic_pair_greedy if self.greedy else matching.economic_pair
        return self._measure(run(self.free), "economic")

    @cached_property
    def fx(self) -> DataFrame:
        run = matching.fx_greedy if self.greedy else matching.fx
        return self._measure(run(self.free, self.economic.select("txn_id")), "fx")

    @cached_property
    def edges(self) -> DataFrame:
        """The tables of the passes side by side; never broadcast, as a union forgets that its tables are marked."""
        return unfolded(union_all([self.exact, self.economic, self.fx]))

    @cached_property
    def unresolved(self) -> DataFrame:
        later = self.economic.unionByName(self.fx).select("txn_id")
        return self._measure(self.free.join(unfolded(later), "txn_id", "left_anti"), "unresolved")

    @property
    def matched(self) -> int:
        """The number of matched records, from what was counted as the stages were written."""
        _ = self.unresolved
        return self.measured["rows"].counts["n"] - self.measured["unresolved"].counts["n"]

    def throughput(self) -> DataFrame:
        """One row: total_in, matched, unresolved, match_rate, seconds of the matching stages, records_per_sec.

        Rows are counted while the stages are written: no job is run for it. An empty batch has a rate of 0.
        """
        _ = self.unresolved  # makes all stages
        total, left = (self.measured[x].counts["n"] for x in ("rows", "unresolved"))
        seconds = sum(self.measured[x].seconds for x in ("exact", "free", "economic", "fx", "unresolved"))
        row = (total, total - left, left, (total - left) / total if total else 0.0, seconds, total / seconds)
        return self.rows.sparkSession.createDataFrame([row], "total_in long, matched long, unresolved long, match_rate double, seconds double, records_per_sec double")

    @cached_property
    def unbanked(self) -> DataFrame:
        return kept(exceptions.unbanked(self.rows.select(*OPEN), self.edges), "unbanked")

    @cached_property
    def anomalies(self) -> DataFrame:
        return kept(exceptions.twins(self.rows, self.unresolved), "anomalies")

    @cached_property
    def pool(self) -> DataFrame:
        return kept(exceptions.pool(self.unresolved, self.unbanked), "pool")

    @cached_property
    def groupings(self) -> DataFrame:
        return kept(exceptions.groupings(self.pool), "groupings")

    @cached_property
    def found(self) -> DataFrame:
        return kept(exceptions.cascade(self.rows, self.unresolved, self.unbanked, self.anomalies, self.groupings), "found")

    def check(self) -> None:
        """Matched and unresolved records part the batch, and every unresolved one is explained."""
        total, left = self.rows.count(), self.unresolved.count()
        matched = self.edges.select("txn_id").distinct().count()
        if matched + left != total:
            raise ValueError(f"{matched} matched and {left} unresolved of {total}")
        if n := exceptions.unexplained(self.unresolved, self.found).count():
            raise ValueError(f"{n} records are unexplained")


class WorkloadClose(Close):
    """The close of a workload whose events are known: the derived one, or one with an answer key of its own."""

    def __init__(self, arrived: DataFrame, greedy: bool = False, truth: DataFrame | Callable[[DataFrame], DataFrame] | None = None):
        """``truth``: the answer key, or a function that makes it of ``arrived`` as it is stored, with all its columns."""
        super().__init__(arrived, greedy)
        self.given = truth

    @cached_property
    def stored(self) -> DataFrame:
        return kept(self.arrived, "feed", by="source")

    @property
    def feed(self) -> DataFrame:
        return self.stored.select(*COLUMNS)

    @cached_property
    def truth(self) -> DataFrame:
        return workload.truth(self.feed) if self.given is None else self.given(self.stored) if callable(self.given) else self.given

    @property
    def parsing(self) -> DataFrame:
        """The feed through its raw shapes and connectors, planted bad rows among it; for who needs it once, not written."""
        from ..sources import feeds

        raw = {s: feeds.emit(self.feed, s).unionByName(bad) for s, bad in feeds.planted_bad(self.feed.sparkSession).items()}
        return feeds.parse_all(raw)

    @cached_property
    def parsed(self) -> DataFrame:
        """The outcome of each row, and where the row stood if it was not taken in: what is asked of a parse after it was judged."""
        where = F.when(F.col("outcome") != "ok", F.col("locator")).alias("locator")
        return kept(self.parsing.select("source", "external_ref", "outcome", "reason", where), "parsed")

    @property
    def owning(self) -> DataFrame:
        """Records with their event, and whether they are open and flagged; for who needs it once, not written."""
        return scoring.owned(self.rows, self.truth, scoring.flags(self.unresolved, self.unbanked, self.found))

    @cached_property
    def owned(self) -> DataFrame:
        return kept(self.owning, "owned")

    @cached_property
    def per_event(self) -> DataFrame:
        return kept(scoring.events(self.owned), "events")

    def scores(self) -> DataFrame:
        return scoring.scores(scoring.events(self.owned), scoring.false_matches(self.owned, self.edges), exceptions.unexplained(self.unresolved, self.found))


_closes: dict[tuple[str, str], WorkloadClose] = {}


def over_workload(spark: SparkSession, sf_dir: str) -> WorkloadClose:
    """The close of the derived workload; one for each session and folder, so that queries share its stages."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _closes:
        _closes[key] = WorkloadClose(workload.feed(spark, sf_dir))
    return _closes[key]


def forget() -> None:
    """Make every stage again for the next query."""
    _closes.clear()
