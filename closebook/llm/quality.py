"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

* Evidence of a document: its words, hashed into ``BUCKETS``, and the style of its text. Each bucket has a
  log-likelihood ratio of good to bad, counted over the labelled documents that may be learned from; a
  document's vocabulary is the mean over its distinct buckets, counted on the half of the labelled documents
  that it is not in, so that no document vouches for itself. Vocabulary and style fall into bins, which have
  such ratios in turn. Their (tempered) sum, with the global rate of good documents, gives the document's
  own probability.
* Sites: each document counts at its path and host with its label where that is known and may be learned
  from, else with its own probability. A host's rate is the mean of those, shrunk to the global rate; a
  path's is shrunk to its host's. How strongly follows from the data: the spread of the rates between hosts
  (and of paths within hosts) beyond what chance gives, by the method of moments, sets the prior's weight.
* Result: the document's evidence on top of its path's posterior.

All of it is grouped aggregation that Spark combines before the shuffle, so a host with a third of all
rows is no special case; nothing is sampled, and only tables of buckets, bins and totals reach the driver. For
``documents`` the host is the source and the path is the language within the source.

Null or empty texts have the bins of nothing; null hosts and paths are sites of their own; repeated label
rows count once (the largest); without labels all evidence is 0 and the score is 0.5. Scores of 0.5 are kept.
Repeated rows are scored alike. Empty input gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

TEMPER, BUCKETS = 0.7, 1 << 14  # features of one text are not independent


def _bins(text: Column) -> dict[str, Column]:
    """Feature name -> bin number. Every feature looks at the whole text."""
    t = F.coalesce(text, F.lit(""))
    length = F.greatest(F.length(t), F.lit(1)).cast("double")
    count = lambda pattern: F.coalesce(F.regexp_count(t, F.lit(pattern)), F.lit(0)).cast("double")
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.filter(F.split(t, "\n"), lambda w: w != "")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    marks = count(r"[^\p{L}\p{N}\s]")
    step = lambda x, width: F.least(F.floor(x / width), F.lit(40)).cast("int")
    return {
        "marks": step(marks / n_words, 0.1),
        "pairs": step(count(r"[^\p{L}\p{N}\s]{2,}") / n_words, 0.05),
        "digits": step(count(r"\p{N}") / length, 0.02),
        "upper": step(count(r"\p{Lu}") / n_words, 0.05),
        "word": step(length / n_words, 0.5),
        "words": F.floor(F.log2(n_words)).cast("int"),
        "distinct": step(F.size(F.array_distinct(words)) / n_words, 0.05),
        "lines": step(F.size(F.array_distinct(lines)) / n_lines, 0.1),
    }


def _shrunk(total: Column, good: Column, prior: Column, weight: Column) -> Column:
    return (good + weight * prior) / (total + weight)


def _weight(groups: DataFrame, mean: Column) -> float:
    """The prior's weight in documents, from the spread of rates (n, good) about ``mean``."""
    rate = F.col("good") / F.col("n")
    r = groups.agg(
        F.sum(F.col("n") * F.pow(rate - mean, 2)).alias("ss"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.avg(mean * (1 - mean)).alias("within"),
    ).first()
    if not r.k:
        return 1.0
    between = max((r.ss - (r.k - 1) * r.within) / max(r.n - r.nn / r.n, 1.0), 1e-6)
    return min(max(r.within / between - 1, 1.0), 1e6)


def _buckets(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def _half() -> Column:
    return F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)), F.lit(0)).cast("int")


def vocabulary(docs: DataFrame, known: DataFrame, smoothing: float) -> DataFrame:
    """(half, ratios): log-likelihood ratios of all buckets, from the labelled documents of the other half."""
    labelled = docs.select("doc_id", "text").join(small(known), "doc_id").select((1 - _half()).alias("half"), "good", _buckets(F.col("text")).alias("buckets"))
    seen = labelled.select("half", "good", F.explode(F.concat(F.col("buckets"), F.array(F.lit(-1)))).alias("bucket"))  # -1 is in every document
    counts = seen.groupBy("half", "bucket").agg(F.sum("good").alias("g"), F.count(F.lit(1)).alias("n"))
    table = {h: {-1: (0, 0)} for h in (0, 1)}
    for r in counts.collect():  # at most two tables of BUCKETS
        table[r.half][r.bucket] = (r.g, r.n)
    rows = []
    for half, cells in table.items():
        good, n = cells.pop(-1)
        ratios = [0.0] * BUCKETS
        for at, (g, m) in cells.items():
            ratios[at] = math.log((g + smoothing) / (good + 2 * smoothing) * (n - good + 2 * smoothing) / (m - g + smoothing))
        rows.append((half, ratios))
    return docs.sparkSession.createDataFrame(rows, "half int, ratios array<double>")


def classify(docs: DataFrame, labels: DataFrame, allowed: Column, host: Column, path: Column, smoothing: float = 1.0) -> DataFrame:
    """doc_id, doc_evidence (log-likelihood ratio), host_rate, path_rate, score, keep.

    ``allowed`` is an expression of doc_id: the labels that may be learned from.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(allowed).groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("good"))
    known = materialize(known, "quality-known")
    bins = _bins(F.col("text"))
    names = [*bins, "vocabulary"]
    ratios = F.broadcast(vocabulary(docs, known, smoothing))  # two rows of BUCKETS numbers
    rows = docs.select("doc_id", host.alias("host"), path.alias("path"), _half().alias("half"), *(c.alias(f"b_{n}") for n, c in bins.items()), _buckets(F.col("text")).alias("own"))
    mean = F.aggregate("own", F.lit(0.0), lambda acc, b: acc + F.get("ratios", b)) / F.greatest(F.size("own"), F.lit(1))
    rows = rows.join(ratios, "half").withColumn("b_vocabulary", F.greatest(F.least(F.floor(mean / 0.02), F.lit(100)), F.lit(-100)).cast("int"))
    rows = materialize(rows.select("doc_id", "host", "path", *(f"b_{n}" for n in names)), "quality-bins")
    stacked = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"b_{n}").alias("bin")) for n in names))).alias("f")
    seen = rows.join(small(known), "doc_id").select("good", stacked).groupBy("f.feature", "f.bin").agg(F.sum("good").alias("g"), F.count(F.lit(1)).alias("n"))
    cells = {(r.feature, r.bin): (r.g, r.n) for r in seen.collect()}  # features x bins
    n_all = sum(n for (f, _), (_, n) in cells.items() if f == names[0])
    n_good = sum(g for (f, _), (g, _) in cells.items() if f == names[0])
    rate = (n_good + 1) / (n_all + 2)
    evidence = F.lit(0.0)
    for name in names:
        own = {b: v for (f, b), v in cells.items() if f == name}
        width = smoothing * (len(own) + 1)
        ratio = [x for b, (g, n) in sorted(own.items()) for x in (b, ((g + smoothing) / (n_good + width), (n - g + smoothing) / (n_all - n_good + width)))]
        if ratio:
            table = F.create_map(*[F.lit(math.log(x[0] / x[1])) if isinstance(x, tuple) else F.lit(x) for x in ratio])
            evidence = evidence + F.coalesce(F.try_element_at(table, F.col(f"b_{name}")), F.lit(0.0))
    scored = materialize(rows.select("doc_id", "host", "path", (TEMPER * evidence).alias("doc_evidence")), "quality-evidence")
    logit = lambda p: F.log(p / (1 - p))
    inside = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    p = F.coalesce(F.col("good").cast("double"), sigmoid(F.col("doc_evidence") + logit(F.lit(rate))))
    judged = scored.join(small(known), "doc_id", "left")
    paths = materialize(judged.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("good")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    overall = F.lit(paths.agg(F.sum("good") / F.sum("n")).first()[0] or rate)
    weight = F.lit(_weight(hosts, overall))
    hosts = hosts.select(F.col("host").alias("h_host"), _shrunk(F.col("n"), F.col("good"), overall, weight).alias("host_rate"))
    hosts = materialize(hosts, "quality-hosts")
    joined = paths.join(small(hosts), F.col("host").eqNullSafe(F.col("h_host")))
    weight = F.lit(_weight(joined, F.col("host_rate")))
    sites = materialize(
        joined.select(
            F.col("host").alias("s_host"), F.col("path").alias("s_path"), "host_rate",
            _shrunk(F.col("n"), F.col("good"), F.col("host_rate"), weight).alias("path_rate"),
        ),
        "quality-sites",
    )
    at = F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path"))
    out = scored.join(small(sites), at)
    score = sigmoid(F.col("doc_evidence") + logit(inside(F.col("path_rate"))))
    if not cells:
        score = F.lit(0.5)
    return out.select("doc_id", "doc_evidence", "host_rate", "path_rate", score.alias("score")).withColumn("keep", F.col("score") >= 0.5)
