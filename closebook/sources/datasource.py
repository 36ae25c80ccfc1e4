"""The feeds' raw JSON lines as a Spark data source, for batches and streams: ``spark.read.format("closebook_feed")``.

Options: ``source`` (gateway, settlement, bank, gl), ``path`` (a folder or file of any file system that pyarrow opens),
``split_bytes``. Files are cut into byte ranges, one partition each, at the lines that begin in them. Filters on columns
that compare with a constant are tested where the lines are read, so that only wanted rows become Arrow batches. Rows have the feed's declared
columns and the two that connectors carry along: where a line stood (``file, byte #n``) and its text if it can't be read.

A stream takes whole files in order of (time of change, name): a file must be complete when it appears, with a later time
than those before it. Its offset is the last file's, so a restarted batch reads the same files again.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from .feeds import CONNECTORS, RAW
from .files import DAMAGED, PLACE

NAME, SPLIT_BYTES, ROWS = "closebook_feed", 64 << 20, 4096
_TESTS = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}


@dataclass
class Range(D.InputPartition):
    """The lines of a file that begin in [start, stop)."""

    path: str
    start: int
    stop: int


def _kinds(source: str) -> dict[str, str]:
    """Column -> long, string or boolean, as declared."""
    out = {}
    for part in RAW[source].split(", "):
        name, _, kind = part.rpartition(" ")
        out[name.strip("`")] = kind
    return out


def record(line: str, kinds: dict[str, str]) -> dict | None:
    """A line's fields; None if it is no object of the declared types. What is no text is told as JSON where text is declared."""
    try:
        found = json.loads(line)
    except (ValueError, RecursionError):
        return None
    if not isinstance(found, dict):
        return None
    out = {}
    for name, kind in kinds.items():
        value = found.get(name)
        if value is not None:
            if kind == "string":
                value = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))
            elif kind == "long" and (not isinstance(value, int) or isinstance(value, bool) or not -(1 << 63) <= value < 1 << 63) or kind == "boolean" and not isinstance(value, bool):
                return None
        out[name] = value
    return out


class _Files:
    """What batch and stream readers share: listing, ranges, and reading one range."""

    def __init__(self, options, source: str):
        self.path, self.split, self.kinds, self.wanted = options["path"], int(options.get("split_bytes", SPLIT_BYTES)), _kinds(source), []

    def listed(self) -> list[tuple[int, str, int]]:
        """(time of change, path, bytes) of the files, hidden ones left out."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        at = system.get_file_info(root)
        found = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
        return sorted((int(f.mtime_ns or 0), f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")

    def ranges(self, files: list[tuple[int, str, int]]) -> list[Range]:
        return [Range(path, i, min(size, i + self.split)) for _, path, size in files for i in range(0, size, self.split)]

    def read(self, part: Range) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        schema = pa.schema([*((c, types[k]) for c, k in self.kinds.items()), (PLACE, pa.string()), (DAMAGED, pa.string())])
        name, rows = part.path.rsplit("/", 1)[-1], []
        with system.open_input_file(part.path) as raw:
            for at, line in self._lines(raw, part):
                text = line.decode("utf-8", "replace")
                if not text.strip():
                    continue
                found = record(text, self.kinds)
                row = (found or dict.fromkeys(self.kinds)) | {PLACE: f"{name}, byte #{at}", DAMAGED: text if found is None else None}
                if all(row[c] is not None and test(row[c], value) for c, test, value in self.wanted):
                    rows.append(row)
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    @staticmethod
    def _lines(raw, part: Range) -> Iterator[tuple[int, bytes]]:
        """(offset, line) of the lines that begin in the range; the byte before tells whether one begins at its start."""
        raw.seek(max(0, part.start - 1))
        at, held = max(0, part.start - 1), b""
        skipping = part.start > 0
        while True:
            block = raw.read(1 << 20)
            held += block
            *lines, rest = held.split(b"\n")
            if not block:
                lines, rest = ([rest] if rest else []), b""
            for line in lines:
                if skipping:
                    skipping = False
                elif at >= part.stop:
                    return
                else:
                    yield at, line.removesuffix(b"\r")
                at += len(line) + 1
            held = rest
            if not block or not skipping and at >= part.stop:
                return


class FeedReader(_Files, D.DataSourceReader):
    def pushFilters(self, filters):
        """Comparisons of a column with a constant, and tests for null, are done by the reader; Spark does the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in self.kinds:
                yield f
            elif type(f) in _TESTS:
                self.wanted.append((column, _TESTS[type(f)], f.value))
            elif isinstance(f, D.In):
                self.wanted.append((column, lambda x, among: x in among, f.value))
            elif isinstance(f, D.IsNotNull):
                self.wanted.append((column, lambda x, _: True, None))
            else:
                yield f

    def partitions(self):
        return self.ranges(self.listed())


class FeedStream(_Files, D.DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.listed()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return self.ranges([f for f in self.listed() if after < f[:2] <= upto])


class FeedSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _source(self) -> str:
        if self.options.get("source") not in RAW:
            raise ValueError(f"option source is one of {sorted(RAW)}")
        return self.options["source"]

    def schema(self) -> T.StructType:
        kinds = {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}
        return T.StructType([T.StructField(c, kinds[k]) for c, k in [*_kinds(self._source()).items(), (PLACE, "string"), (DAMAGED, "string")]])

    def reader(self, schema: T.StructType) -> FeedReader:
        return FeedReader(self.options, self._source())

    def streamReader(self, schema: T.StructType) -> FeedStream:
        return FeedStream(self.options, self._source())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)


def load(spark: SparkSession, source: str, path: str, stream: bool = False, **options) -> DataFrame:
    """A feed through the data source and its connector: canonical rows with outcome, reason, locator."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format(NAME).options(source=source, path=path, **options)
    return CONNECTORS[source](reader.load())
