"""Redaction against its SQL where words touch letters beyond ASCII, and blanks are unusual."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from closebook.functions import text

TEXTS = [
    "CIÓNMIÍRR ASESRR ÑOS UEÍOS UEIE, OSESGAIEDO", "LA. ÉAI ÉONLEEAU POUR AN ÉONQUEÊ AIVI AI", "Éa@b.co ñ9876543210ñ Ñ123456789Ñ",
    "AB\x0bCD EF\x0cGH", "+91\x0b9876543210 AB_CD EF", "NEFT CR ÉAB CD", "é91 9876543210", None,
]


@pytest.fixture(scope="module")
def expected(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("redact"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        return folder, dict(db.execute(__spark_entry__.oracle_sql()["redact_documents"]).fetchall())


def test_words_end_at_letters_beyond_ascii(spark, expected):
    folder, want = expected
    assert dict(__spark_entry__.queries()["redact_documents"](spark, folder).collect()) == want
    assert want[0] == "CIÓNMIÍ[NAME] Ñ[NAME]Í[NAME], OSESGAIEDO"


def test_json_is_redacted_alike(spark, expected):
    _, want = expected
    asked = [(i, json.dumps(t)) for i, t in enumerate(TEXTS) if t is not None]
    told = spark.createDataFrame(asked, "i long, t string").select("i", text.redact_json(F.col("t"))).collect()
    assert {i: json.loads(t) for i, t in told} == {i: t for i, t in want.items() if t is not None}
