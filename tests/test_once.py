"""What a row costs: nothing is parsed twice, and the code made for a row is small enough to be compiled."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from closebook.plans import generator, workload
from closebook.sources import feeds

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("source", "most"), [("gl", 2), ("settlement", 3), ("bank", 1)])
def test_a_filter_on_the_outcome_parses_no_amount_again(spark, source, most):
    raw = spark.range(3).select(*(F.col("id").cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], feeds.RAW[source]).schema))
    kept = feeds.CONNECTORS[source](raw).filter("outcome = 'ok'").select("seq", "amount_minor", "value_date")
    assert 0 < kept._jdf.queryExecution().optimizedPlan().toString().count("^[+-]?(") <= most


@pytest.mark.parametrize("rows", [lambda spark: workload.feed(spark, SF), lambda spark: generator.generate(spark, 1_000).rows], ids=["derived", "generated"])
def test_code_of_a_feed_row_is_compiled(spark, rows):
    told = io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else no code is made before a run
    try:
        with contextlib.redirect_stdout(told):
            rows(spark).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", told.getvalue())]
    assert sizes and max(sizes) < 8_000, sizes


@pytest.mark.parametrize(("ref", "per_line"), [("k", False), ("'a' || n", False), ("'a' || k || '_' || n", False), ("'a' || k", True)])
def test_references_of_other_forms_are_refused(ref, per_line):
    with pytest.raises(ValueError):
        workload._prefix(ref, per_line)


def test_parsing_once_keeps_columns_and_rows(spark):
    bad = feeds.planted_bad(spark)
    for source, raw in bad.items():
        df = feeds._once(raw)
        assert df.columns == raw.columns and [f.dataType for f in df.schema] == [f.dataType for f in raw.schema]
        assert df.count() == raw.count() and df.subtract(raw).count() == 0
