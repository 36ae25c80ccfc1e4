"""The network and its thresholds come from every labelled document, in an order that tells nothing."""

import random

import numpy as np
from pyspark.sql import functions as F

from closebook.llm import toxicity


def test_every_labelled_document_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_DOCS", 40)
    rng = random.Random(8)
    rows = []
    for i in range(240):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(30)]
        rows.append((i, " ".join(words + ["zorking"] * (2 if i % 3 == 0 else 0)), "en"))
    rows.append((240, "woorden " * 2000, "nl"))  # too long for the documents that a network starts from
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(241)], "doc_id long, toxic int")
    nets = [toxicity.fit(t, marks, F.lit(True), per_class=30, class_bytes=100_000) for t in (table, table.orderBy(F.desc("doc_id")).repartition(7))]
    assert nets[0].langs == ["en", "nl"] and nets[0].trained
    for a, b in zip(*(n._weights().values() for n in nets), strict=True):
        assert np.array_equal(a, b)
    assert np.array_equal(nets[0].thresholds, nets[1].thresholds)
    # one document more, outside the start, moves the weights
    fewer = toxicity.fit(table, marks.filter("doc_id < 240"), F.lit(True), per_class=30, class_bytes=100_000)
    assert not np.array_equal(fewer.table, nets[0].table)
    got = toxicity.score(table, marks, F.lit(False), per_class=30).collect()
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in got if r.doc_id < 240) >= 220


def test_every_labelled_document_is_counted_by_language(spark):
    from closebook.llm import langid

    table = spark.createDataFrame([(i, "dada", "a") for i in range(3000)] + [(3000, "nono", "b")], "doc_id long, text string, lang string")
    model = langid.fit(table, F.lit(True))
    assert model.langs == ["a", "b"] and int(model.n.sum()) == 4 * 3001  # four trigrams a document, framed by spaces
