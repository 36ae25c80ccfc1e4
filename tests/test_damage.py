"""Damaged files and their locators, nested redaction, and pages that lose nothing."""

import json
import random

import pytest
from pyspark.sql import Row

from closebook.functions import text
from closebook.operators import serving
from closebook.sources import files

GOOD = {"seq": 1, "voucher_no": "v1", "gl_date": "2026-08-01", "account": "a", "party": "p", "debit": "1.00", "credit": "0.00", "narration": "n", "currency": "INR", "status": "settled"}


def test_every_bad_line_has_its_file_and_number(spark, tmp_path):
    rng, want = random.Random(5), {}
    for name in ("a.json", "b.json", "c.json"):
        out = []
        for i in range(700):
            row, kind = GOOD | {"seq": i, "voucher_no": f"{name}{i}"}, rng.randrange(12)
            line = json.dumps(row)
            place = f"{name}, record #{i}"
            if kind == 0:
                line, want[place] = line[: rng.randrange(1, 60)], "malformed_record"
            elif kind == 1:
                line, want[place] = json.dumps(row | {"voucher_no": "  "}), "missing_reference"
            elif kind == 2:
                line, want[place] = json.dumps(row | {"seq": "x" * 5}), "malformed_record"
            elif kind == 3:
                line = rng.choice(["", "   "])  # no record
            elif kind == 4:
                line, want[f"{name}{i}"] = json.dumps(row | {"status": "lost"}), "unknown_status"
            elif kind == 5:
                line, want[place] = "[1, 2]", "malformed_record"
            out.append(line)
        (tmp_path / name).write_text("\n".join(out) + "\n")
    for split in ("128m", "4096"):  # whole files, and files in many splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = {r.locator: r.reason for r in files.scan(spark, "gl", str(tmp_path)).filter("outcome = 'reject'").collect()}
            assert got == want
            assert files.scan(spark, "gl", str(tmp_path)).filter("outcome = 'ok'").count() + len(got) == sum(bool(x.strip()) for n in ("a.json", "b.json", "c.json") for x in (tmp_path / n).read_text().split("\n"))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_lines_are_located_behind_their_header(spark, tmp_path):
    head = "seq,Txn Date,Value Date,Description,Ref No./Cheque No.,Debit,Credit,Balance\n"
    (tmp_path / "s.csv").write_text(head + '1,01/08/2026,01/08/2026,"NEFT CR-U1-ACME, LTD",U1,,"1,000.00",\n2,01/08/2026\n3,01/08/2026,01/08/2026,NEFT CR,,,1.00,\nx,01/08/2026,01/08/2026,NEFT CR,U4,,1.00,\n')
    got = {r.locator: (r.outcome, r.reason, r.amount_minor) for r in files.scan(spark, "bank", str(tmp_path), "csv").collect()}
    assert got["U1"] == ("ok", None, 100_000) and got["s.csv, record #3"][1] == "missing_reference" and got["s.csv, record #4"][1] == "malformed_record"
    assert got["s.csv, record #2"][:2] == ("reject", "malformed_record")


MAIL = {"email": "a@b.co", "x": "A@b.co", "n": "1"}


def test_maps_lists_and_payloads_are_redacted(spark):
    row = spark.createDataFrame([(MAIL, {"phone": Row(a="q@r.st")}, [["a@b.co"]], [{"party": "P", "z": "a@b.co"}], {1: "a@b.co"}, None)],
        "m map<string,string>, deep map<string,struct<a:string>>, lists array<array<string>>, maps array<map<string,string>>, by_number map<int,string>, none map<string,string>")
    r = text.redact_row(row).first()
    assert r.m == {"email": "[REDACTED]", "x": "[EMAIL]", "n": "1"} and r.deep == {"phone": None}
    assert r.lists == [["a@b.co"]] and r.maps == [{"party": "[REDACTED]", "z": "[EMAIL]"}] and r.by_number == {1: "[EMAIL]"} and r.none is None
    payload = {"Email": "a@b.co", "x": ["c@d.ef", ["c@d.ef"], {"Contact": None, "t": "call 9876543210 or 123456789"}], "n": 1.5, "big": 12345678901234567890, "who": "JOHN SMITH NEFT CR", "é": True}
    want = {"Email": "[REDACTED]", "x": ["[EMAIL]", ["c@d.ef"], {"Contact": "[REDACTED]", "t": "call [PHONE] or [ACCT:6789]"}], "n": 1.5, "big": 12345678901234567890, "who": "[NAME] CR", "é": True}
    table = spark.createDataFrame([(1, json.dumps(payload)), (2, "not json a@b.co"), (3, None)], "i int, p string")
    got = {r.i: r.p for r in table.select("i", text.redact_json(table.p).alias("p")).collect()}
    assert got[2] == "not json [EMAIL]" and got[3] is None
    plain = table.filter("i = 1").selectExpr("from_json(p, 'who string').who AS who")
    assert json.loads(got[1]) | {"who": 0} == want | {"who": 0} and json.loads(got[1])["who"] == plain.select(text.redact(plain.who)).first()[0]
    variant = text.redact_row(table.filter("i = 1").selectExpr("parse_json(p) AS v")).selectExpr("to_json(v)").first()[0]
    assert json.loads(variant)["x"] == want["x"]


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 100])
def test_a_walk_serves_every_row_once(spark, limit):
    entries = spark.createDataFrame(
        [(1, "d", [f"s{i % 2}"], "same", i // 4) for i in range(8)] + [(1, "d", ["s0"], "same", 0)] * 4 + [(None, "d", None, None, 1), (2, "d", [], None, None), (None, "d", ["z"], "r", 2)],
        "phase int, decision string, subjects array<string>, reason string, extra int",
    )
    found = spark.createDataFrame([("a", None, "INR"), ("b", None, "INR"), ("b", None, "INR"), ("c", 5, None), ("d", 5, "INR"), ("e", 7, "INR"), (None, 7, "INR")], "subject_id string, at_risk long, currency string")
    for name, df in (("audit", serving.audit_list(entries)), ("exceptions", found)):
        cursor, seen = None, []
        while True:
            page = serving.page(df, name, cursor, limit)
            assert len(page.items) <= limit
            seen += page.items
            if (cursor := page.next) is None:
                break
        want = [tuple(map(str, r)) for r in df.collect()]
        assert sorted(tuple(map(str, r)) for r in seen) == sorted(want)
        if name == "exceptions":
            assert [r.at_risk for r in seen] == [7, 7, 5, 5, None, None, None]
    for bad in ("nonsense", serving._cursor([1]), serving._cursor([1, 2, 3, 4, -1])):
        with pytest.raises(serving.BadPage):
            serving.page(found, "exceptions", bad)
