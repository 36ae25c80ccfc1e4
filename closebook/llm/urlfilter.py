"""URL filters: explicit rules first, then segmented host and path words scored by naive Bayes.

Host names are often words run together. A unigram Viterbi pass splits each name into the likeliest words
of a lexicon: the words that the table's own urls show apart (parts of hyphenated names, words of paths), each
with its count over all rows, and a few example words. A multinomial naive Bayes model scores the words of
host and path together. Its labelled rows are the urls that the rules decide, of all the table; names that a
rule itself names say nothing, or the model would only repeat the rules where they do not hold. The example
words are its prior, ``PRIOR`` occurrences each. Words that neither shows say nothing.

All of it runs over distinct names: names and their counts are one aggregation, each name is given the slice
of the lexicon that its substrings hit by a join, and scores come back by a join. There is no bound on the
lexicon or on the length of its words, and nothing of it goes through the driver.

A rule ``host/path`` fits that host and its subdomains, for paths that start with its path; the longest
fitting rule decides. Null urls and such without ``://`` have an empty host and path and, like all urls
without a known word, take the class that is likelier at large: allow. Equal likelihoods are allowed. Repeated
rows are judged alike; an empty table gives no rows; extra columns are ignored; urls of any length are judged
whole.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

LETTERS, PART, PRIOR, PRIOR_BLOCK, SMOOTHING = 24, 256, 5, 0.25, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules as (verdict, host/path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: The prior's words; a parameter of ``judge``.
EXAMPLES = (
    ("block", "cheap pills online pharmacy no prescription cheap meds viagra cialis discount pills store"),
    ("block", "free bets casino poker slots jackpot betting bonus free spins roulette sportsbook odds"),
    ("block", "adult x xxx porn sex cam nude escort dating hookup hot girls adult video"),
    ("block", "spam farm link farm seo backlinks traffic exchange click bait spam mail bulk"),
    ("block", "payday loans fast cash easy money get rich crypto doubler forex signals prize winner"),
    ("block", "warez crack keygen torrent free download serial replica watches fake luxury"),
    ("allow", "news daily times herald weather world local report magazine journal press"),
    ("allow", "blog home page notes garden kitchen recipes travel photo music books"),
    ("allow", "university school library science research health museum history art city council"),
    ("allow", "shop store office software cloud data open source developer docs wiki forum support"),
    ("allow", "www mail web site online page post index about contact archive category tag article"),
    ("allow", "football club sports team video game film review event market bank insurance"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, action), or null."""
    found = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,action:string>")


def split_name(name: str, log: dict[str, float], unknown: float) -> list[str]:
    """The likeliest words; a piece outside the lexicon costs more the longer it is.

    ``log`` holds at least those words of the lexicon that occur in the name.
    """
    long = [w for w in log if len(w) > LETTERS and w in name]
    lengths = sorted({len(w) for w in long} | set(range(1, LETTERS + 1)), reverse=True)
    ends: dict[tuple[int, int], str] = {}  # of long words, found by search and never cut out
    for w in long:
        at = name.find(w)
        while at >= 0:
            ends[at + len(w), len(w)] = w
            at = name.find(w, at + 1)
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        top = (-math.inf, 0)
        for n in lengths:  # of equals the longest last word
            if n > end:
                continue
            known = log.get(name[end - n : end] if n <= LETTERS else ends.get((end, n), ""))
            value = best[end - n] + (known if known is not None else unknown - 2.3 * n)
            if value > top[0]:
                top = (value, end - n)
        best.append(top[0])
        back.append(top[1])
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def _splitter(total: float):
    def run(batches):
        unknown = math.log(1 / total)
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            names = batch.column("name").to_pylist()
            words = [split_name(name, {w["word"]: math.log(w["n"] / total) for w in slice_ or ()}, unknown) for name, slice_ in zip(names, batch.column("slice").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    return run


def _names(rows: DataFrame) -> DataFrame:
    """A row for each name of host labels and path, in order: the row's columns, at, name, apart; urls without names keep one."""
    path = F.translate("path", UPPER, LOWER)
    # Host labels as they lie between dots; what is hyphenated is shown apart.
    labels = F.transform(F.split("host", r"\."), lambda x: F.transform(F.split(x, "[^a-z]+"), lambda w: F.struct(w.alias("name"), x.contains("-").alias("apart"))))
    names = F.concat(F.flatten(labels), F.transform(F.split(path, "[^a-z]+"), lambda w: F.struct(w.alias("name"), F.lit(True).alias("apart"))))
    return rows.select("*", F.posexplode_outer(F.filter(names, lambda x: x["name"] != "")).alias("at", "x")).select(
        *rows.columns, "at", F.col("x.name").alias("name"), F.coalesce("x.apart", F.lit(False)).alias("apart")
    )


def _examples(spark, examples) -> DataFrame:
    """(word, block, allow): occurrences among the example words."""
    counts: dict[str, dict[str, int]] = {}
    for label, line in examples:
        for w in line.split():
            counts.setdefault(w, {"block": 0, "allow": 0})[label] += 1
    return spark.createDataFrame([(w, c["block"], c["allow"]) for w, c in sorted(counts.items())], "word string, block long, allow long")


def lexicon(per_name: DataFrame, prior: DataFrame) -> tuple[DataFrame, float]:
    """(word, n) and the sum of n: words shown apart, and example words, each as likely as a fairly frequent one."""
    shown = per_name.filter("apart > 0").select(F.col("name").alias("word"), F.col("apart").cast("double").alias("n"))
    base = 1 + (shown.agg(F.sum("n")).first()[0] or 0.0) / 1000
    words = materialize(shown.unionByName(prior.select("word", ((F.col("block") + F.col("allow")) * base).alias("n"))).groupBy("word").agg(F.sum("n").alias("n")), "url-lexicon")
    return words, words.agg(F.sum("n")).first()[0] or 1.0


def segmented(per_name: DataFrame, words: DataFrame, total: float) -> DataFrame:
    """(name, words): every name with the words of the lexicon that it may hold.

    A name gives its pieces of up to ``LETTERS`` letters; a longer word is met by its first ``LETTERS``, and whether all of
    it is there is seen when the name is split. Long names are cut into overlapping parts first, and
    travel under a digest, so their pieces cost what those of many short names do.
    """
    key = F.when(F.length("name") > 2 * LETTERS, F.concat(F.lit("#"), F.sha2("name", 256))).otherwise(F.col("name"))
    keyed = per_name.select("name", key.alias("key"))
    begins = F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1)), F.lit(PART))
    parts = keyed.select("key", F.explode(F.transform(begins, lambda i: F.substring("name", i, PART + LETTERS - 1))).alias("part"))
    lengths = F.filter(F.sequence(F.lit(1), F.lit(LETTERS)), lambda n: n <= F.length("part"))
    cuts = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length("part") - n + 1), lambda i: F.substring("part", i, n))))
    pieces = parts.select("key", F.explode(F.array_distinct(cuts)).alias("begin"))
    known = words.withColumn("begin", F.substring("word", 1, LETTERS))
    slices = pieces.join(known, "begin").groupBy("key").agg(F.collect_set(F.struct("word", "n")).alias("slice"))  # at most a name's pieces
    return materialize(keyed.join(slices, "key", "left").select("name", "slice").mapInArrow(_splitter(total), "name string, words array<string>"), "url-segments")


def odds(per_name: DataFrame, segments: DataFrame, prior: DataFrame, weight: float = PRIOR) -> DataFrame:
    """(word, odds): log-likelihood ratio of block to allow, with additive smoothing over the words that have counts."""
    labelled = segments.join(per_name.filter("block + allow > 0").select("name", "block", "allow"), "name")
    seen = labelled.select(F.explode("words").alias("word"), F.col("block").cast("double").alias("block"), F.col("allow").cast("double").alias("allow"))
    both = seen.unionByName(prior.select("word", (F.col("block") * weight).alias("block"), (F.col("allow") * weight).alias("allow")))
    counts = materialize(both.groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "url-counts")
    n = counts.agg(F.count(F.lit(1)).alias("words"), F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    share = lambda c: (F.col(c) + SMOOTHING) / ((n[c] or 0.0) + SMOOTHING * n.words)
    return counts.select("word", F.log(share("block") / share("allow")).alias("odds"))


def judge(pages: DataFrame, rules=RULES, examples=EXAMPLES, prior_block: float = PRIOR_BLOCK) -> DataFrame:
    """page_id, host, path, rule, verdict, words (as segmented), log_odds (of block, by the model)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.action")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    names = _names(rows)
    ruled = sorted({w for _, rule in rules for w in re.split("[^a-z]+", rule.lower()) if w})
    by_rule = lambda action: F.count_if((F.col("action") == action) & ~F.col("name").isin(*ruled))
    per_name = names.filter("name IS NOT NULL").groupBy("name").agg(F.count_if("apart").alias("apart"), by_rule("block").alias("block"), by_rule("allow").alias("allow"))
    per_name = materialize(per_name, "url-names")
    prior = _examples(pages.sparkSession, examples)
    segments = segmented(per_name, *lexicon(per_name, prior))
    known = odds(per_name, segments, prior)
    pieces = segments.select("name", F.posexplode("words").alias("place", "word"))
    scored = pieces.filter(~F.col("name").isin(*ruled)).join(known, "word").groupBy("name").agg(F.sum("odds").alias("odds"))
    scored = small(materialize(segments.join(scored, "name", "left"), "url-scores"))
    judged = names.select("row", "at", "name").filter("name IS NOT NULL").join(scored, "name").groupBy("row").agg(
        F.concat_ws(" ", F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"]))).alias("words"), F.sum("odds").alias("odds")
    )
    log_odds = F.lit(math.log(prior_block / (1 - prior_block))) + F.coalesce("odds", F.lit(0.0))
    out = rows.join(judged, "row", "left").select("page_id", "host", "path", "rule", "action", F.coalesce("words", F.lit("")).alias("words"), log_odds.alias("log_odds"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "words", "log_odds")
