"""Runs that outlive their session: tables under a run's own folder, seen by others from the moment its marker exists.

A run writes its tables first and publishes them last, by creating one small empty file. So a run is there whole or not at
all, a run that died is invisible, and two writers can't take one number, as its file may not exist before. Any session that reaches
the folder reads the current run, or one by name, and serves pages from it without computing anything again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, matching, serving
from ..operators.access import NotFound, Principal
from ..storage import kept, passing
from . import generator
from .close import Close

# How many events a run on demand may have.
FEWEST, MOST = 1, 50_000
REPORT = "total_in long, accepted long, deduplicated long, rejected long, skipped long"
KEPT, MARKS, CLAIMS, TABLES = 5, "_published", "_numbers", "runs"


class BadSize(ValueError):
    """A number of events that no run has."""


class StoredRun:
    """A published run: its tables as they were written."""

    def __init__(self, spark: SparkSession, folder: str, about: dict):
        self.spark, self.folder, self.about, self.name = spark, folder, about, about["run"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @cached_property
    def summary(self) -> DataFrame:
        return self.table("summary")

    def transactions(self, source: str | None = None) -> DataFrame:
        return serving.transactions(self.table("rows"), source)

    def page(self, name: str, cursor: str | None = None, limit: int = serving.LIMIT, **wanted) -> serving.Page:
        """A page of transactions, exceptions, matches or audit; ``wanted`` are equality filters."""
        if name == "audit":
            listed = serving.audit_list(self.table("audit"), wanted.pop("decision", None))
        else:
            listed = self.transactions(wanted.pop("source", None)) if name == "transactions" else self.table(name)
        return serving.page(serving._where(listed, **wanted), name, cursor, limit)

    def exception(self, subject_id: str):
        return serving.exception(self.table("exceptions"), subject_id)


class RunStore:
    """A catalogue of runs in a folder that all sessions share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    @property
    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marks(self) -> list[str]:
        """Names of the markers, oldest first: a number, and the run."""
        at, files = self._path(MARKS), self._files
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def run(self, n_events: int, principal: Principal, seed: int = generator.SEED, greedy: bool = False, **options) -> StoredRun:
        """Generate, close and store a batch of ``FEWEST`` to ``MOST`` events."""
        principal.require("write:run_batch")
        if not FEWEST <= n_events <= MOST:
            raise BadSize(f"a run has {FEWEST} to {MOST} events")
        with passing(self.spark):  # what the close writes on its way goes when the run is stored
            return self.store(generator.run(self.spark, n_events, seed, greedy, **options), {"events": n_events, "seed": seed, "by": principal.subject})

    def store(self, close: Close, about: dict | None = None) -> StoredRun:
        """Write a close's tables under a new run and publish it."""
        name = uuid.uuid4().hex
        folder = f"{self.root}/{TABLES}/{name}"
        rows, edges, found = close.rows, close.edges, close.found
        arrived, accepted = close.feed.count(), close.measured["rows"].counts["n"]
        report = self.spark.createDataFrame([(arrived, accepted, arrived - accepted, 0, 0)], REPORT)  # nothing was parsed, and the rows are the first of each key
        matches = kept(matching.told(edges, rows), "told")
        no_rejects = self.spark.createDataFrame([], "source string, locator string, reason string")
        tables = {
            "rows": rows, "edges": edges, "matches": matches.drop("right_id"), "exceptions": found, "groupings": close.groupings, "tiers": matching.tier_breakdown(edges),
            "audit": audit.trail(report, no_rejects, edges, found, matches, close.matched).withColumn("run", F.lit(name)), "summary": serving.summary(rows, edges, found, close.matched, matches.count()).withColumn("run", F.lit(name)),
        }
        tables["about"] = self.spark.createDataFrame([(json.dumps((about or {}) | {"run": name}),)], "value string")
        for table, df in tables.items():
            df.write.parquet(f"{folder}/{table}")
        self.publish(name)
        return self.open(name)

    def publish(self, name: str) -> None:
        """Claim the next free number, then show the run under it; whoever comes second takes the number after."""
        files = self._files
        files.mkdirs(self._path(CLAIMS))
        files.mkdirs(self._path(MARKS))
        number = 1 + max((int(s.getPath().getName()) for s in files.listStatus(self._path(CLAIMS))), default=-1)
        while not files.createNewFile(self._path(CLAIMS, f"{number:010d}")):
            number += 1
        files.createNewFile(self._path(MARKS, f"{number:010d}-{name}"))

    def names(self) -> list[str]:
        """Published runs, oldest first."""
        return [m.split("-", 1)[1] for m in self._marks()]

    def open(self, name: str | None = None) -> StoredRun:
        """A published run; the latest one if no name is given."""
        known = self.names()
        if not known or name is not None and name not in known:
            raise NotFound(name or "no run is published")
        folder = f"{self.root}/{TABLES}/{name or known[-1]}"
        return StoredRun(self.spark, folder, json.loads(self.spark.read.parquet(f"{folder}/about").first()[0]))

    def retain(self, keep: int = KEPT) -> list[str]:
        """Remove all but the latest runs: each marker first, so that no one opens a run that is going."""
        gone = []
        for mark in self._marks()[: -keep or None]:
            name = mark.split("-", 1)[1]
            self._files.delete(self._path(MARKS, mark), False)
            self._files.delete(self._path(TABLES, name), True)
            gone.append(name)
        return gone

    def unpublished(self) -> Iterator[str]:
        """Folders without a marker: runs under way, or dead."""
        at, files, known = self._path(TABLES), self._files, set(self.names())
        if files.exists(at):
            yield from (n for s in files.listStatus(at) if (n := s.getPath().getName()) not in known)
