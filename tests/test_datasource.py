"""The data source against the file reader: the same rows in any split, pushed filters, and streams that restart."""

import json
import os

import pytest
from pyspark.sql import functions as F

from closebook.plans.close import over_workload
from closebook.sources import datasource, feeds, files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("feeds")
    for source in feeds.RAW:
        raw = feeds.emit(over_workload(spark, SF).feed, source)
        raw.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in raw.columns))).alias("value")).repartition(3).write.text(str(at / source))
    return at


def rows(df, *drop):
    return sorted(map(repr, df.drop("locator", *drop).collect()))


@pytest.mark.parametrize("source", list(feeds.RAW))
def test_same_rows_as_the_connectors(spark, folder, source):
    want = rows(feeds.CONNECTORS[source](feeds.emit(over_workload(spark, SF).feed, source)))
    for split in (datasource.SPLIT_BYTES, 5000):
        assert rows(datasource.load(spark, source, str(folder / source), split_bytes=str(split))) == want
    assert rows(files.scan(spark, source, str(folder / source))) == want


def test_ranges_cut_at_lines(spark, tmp_path):
    lines = [json.dumps({"seq": i, "voucher_no": "é" * (i % 7)}) if i % 5 else "x" * (i % 11) for i in range(200)]
    text = "\n".join(lines)
    for end in ("", "\n", "\r\n"):
        (tmp_path / "f.json").write_bytes((text + end).encode())
        datasource.register(spark)
        for split in (1, 7, 64, 1000, 1 << 20):
            got = spark.read.format(datasource.NAME).options(source="gl", path=str(tmp_path / "f.json"), split_bytes=str(split)).load() if split > 1 else None
            if got is None:  # as many partitions as bytes: without Spark
                source = datasource.FeedReader({"path": str(tmp_path / "f.json"), "split_bytes": "1"}, "gl")
                found = [r for p in source.partitions() for b in source.read(p) for r in b.to_pylist()]
                got_rows = sorted((r["_damaged"] or str(r["seq"])) for r in found)
            elif split < 64:
                continue
            else:
                got_rows = sorted((r["_damaged"] or str(r["seq"])) for r in got.collect())
            assert got_rows == sorted(x if not x.startswith("{") else str(json.loads(x)["seq"]) for x in lines if x)


def test_filters_are_pushed(spark, folder):
    datasource.register(spark)
    read = spark.read.format(datasource.NAME).options(source="gateway", path=str(folder / "gateway")).load()
    kept = read.filter("status = 'refunded' AND seq > 1000 AND currency IN ('INR', 'USD') AND id LIKE 'rfnd%'")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == read.cache().filter("status = 'refunded' AND seq > 1000 AND id LIKE 'rfnd%'").count() > 0
    assert "refunded" in plan.split("Filter")[-1] or "PushedFilters" in plan or "refunded" not in plan
    with pytest.raises(Exception, match="source"):
        spark.read.format(datasource.NAME).options(source="lost", path="x").load()


def test_damaged_lines_have_their_byte(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"seq": 1, "voucher_no": "v", "debit": "1.00", "gl_date": "2026-08-01", "status": "settled"}\n{"seq": "x"}\n[1]\n{"voucher_no": ""\n\n')
    got = {r.locator: r.reason for r in datasource.load(spark, "gl", str(tmp_path)).collect()}
    first = len((tmp_path / "d.json").read_text().split("\n")[0]) + 1
    assert got == {"v": None, f"d.json, byte #{first}": "malformed_record", f"d.json, byte #{first + 13}": "malformed_record", f"d.json, byte #{first + 17}": "malformed_record"}


def test_stream_takes_new_files_and_restarts(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    source.mkdir()

    def put(name, *numbers):
        lines = [json.dumps({"seq": n, "voucher_no": f"v{n}", "debit": "1.00", "gl_date": "2026-08-01", "status": "settled"}) for n in numbers]
        (source / name).write_text("\n".join(lines) + "\n")
        os.utime(source / name, ns=(1, 10**18 + sum(numbers)))

    def run():
        stream = datasource.load(spark, "gl", str(source), stream=True)
        query = stream.select("external_ref", "outcome").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(processingTime="1 second").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.external_ref for r in spark.read.parquet(out).collect())

    put("a.json", 1, 2)
    assert run() == ["v1", "v2"]
    put("b.json", 3, 4)
    put("c.json", 5, 6)
    assert run() == ["v1", "v2", "v3", "v4", "v5", "v6"]
    assert run() == ["v1", "v2", "v3", "v4", "v5", "v6"]
