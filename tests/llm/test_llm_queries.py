"""The registered queries against their SQL twins, and the pipeline against its stages done plainly."""

import os

import duckdb
import pytest

import corpus_pipeline
from closebook.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted((plain(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(map(plain, cursor.fetchall()), key=repr)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    """Each stage keeps what it should of its own input, and the tokens are those of the mixed documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF).cache())
        assert seen[-1].columns == docs.columns
    ids = [sorted(r[0] for r in x.select("doc_id").collect()) for x in seen]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:], strict=False)) and len(ids[2]) == len(set(ids[2]))
    toxic = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").select("doc_id").collect()}
    clean = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").select("doc_id").collect()}
    assert len(clean & set(ids[1])) >= 0.95 * len(clean) and len(toxic & set(ids[1])) < len(toxic)
    tokens = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in tokens.collect()) == ids[-1]


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    """No documents at all, and documents with nulls everywhere, repeated rows and one very long text."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f g", None, None, 13), (2, "a b c d e f g", None, None, 13), (3, "w" * 200_000 + " x" * 200_000, "en", "s", 600_000)]
    for rows, want in (([], []), (odd, ["1", "2", "3", "None"])):
        seen = spark.createDataFrame(rows, docs.schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            seen = stage(spark, seen, str(tmp_path))
            assert seen.columns == docs.columns
        got = {str(r[0]) for r in seen.select("doc_id").collect()}
        assert got <= set(want) and ("3" in got) == ("3" in want)
        assert corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path)).count() == seen.count()
