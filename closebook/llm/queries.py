"""One query for each operator, over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, bitpack, decontam, htmltext, langid, mixing, neardup, quality, runs, secretscan, topk, toxicity, urlfilter
from .common import table


def _remainder(n: int):
    """crc32 of the doc_id's text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_score_quality(spark, sf_dir):
    return quality.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _remainder(5) != 0, F.col("source"), F.col("lang")
    )


def op2_identify_language(spark, sf_dir):
    found = langid.identify(table(spark, sf_dir, "documents"), _remainder(4) == 2)
    return found.withColumn("languages", F.concat_ws(",", "languages")).drop("proportions")


def op3_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_score_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _remainder(5) == 0)


def op5_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_extract_text(spark, sf_dir):
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op7_filter_urls(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op8_topk_search(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"))


def op9_decontaminate(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pack_tokens(spark, sf_dir):
    return bitpack.read_digests(spark, bitpack.write_tokens(table(spark, sf_dir, "documents")))


def op11_align_tokenizers(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_scan_secrets(spark, sf_dir):
    return secretscan.report(table(spark, sf_dir, "documents"))


def op13_find_runs(spark, sf_dir):
    return runs.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_score_quality, op2_identify_language, op3_mix_sources, op4_score_toxicity, op5_near_duplicates, op6_extract_text, op7_filter_urls, op8_topk_search, op9_decontaminate, op10_pack_tokens, op11_align_tokenizers, op12_scan_secrets, op13_find_runs)}

ORACLES = {"op3_mix_sources": mixing.ORACLE_SQL, "op5_near_duplicates": neardup.ORACLE_SQL, "op8_topk_search": topk.ORACLE_SQL, "op9_decontaminate": decontam.ORACLE_SQL}
