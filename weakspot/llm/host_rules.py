"""Quality rules at the level of hosts, in DataFrame operations only.

Rules judge each document; failures are summed by host (the source column), each host's failure rate is shrunk towards the
corpus by a beta prior whose two parameters are fitted to the hosts by moments, and the verdict on the host is joined back to
its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, materialize, without_ids

#: A word, and symbols that the rules count.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL_RUN = r"[^#*$%&|<>]+"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: A host is rejected if its shrunk failure rate is over HOST_RATE and over HOST_TIMES the corpus rate.
HOST_RATE, HOST_TIMES = 0.5, 2.0
#: Bounds of the prior's weight, in documents.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _repeats(words: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more, first ones included."""

    def with_names(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(_repeated_starts(w), _covered)))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(F.transform(words, lambda x: F.xxhash64(x)), with_names)).cast("long")


def _repeated_starts(windows: Column) -> Column:
    """Ascending starts of the windows whose name stands more than once."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def pick(s: Column) -> Column:
        twice = F.filter(
            F.transform(s, lambda x, j: F.when((F.get(s, j + 1)["h"] == x["h"]) | (F.get(s, j - 1)["h"] == x["h"]), x["i"])),
            lambda i: i.isNotNull(),
        )
        return F.array_sort(twice)

    return _let(ordered, pick)


def _covered(starts: Column) -> Column:
    """Words covered by windows at the starts: each adds what the next doesn't."""
    n = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW))))
    return F.aggregate(n, F.lit(0), lambda a, x: a + x)


def base(docs: DataFrame) -> DataFrame:
    """doc_id, host and the base values of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    bare = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("host"),
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeats(w).alias("n_repeat_words"))).alias("w"),
        F.length(bare).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOL_RUN, "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "host", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def host_verdicts(judged: DataFrame) -> DataFrame:
    """host and whether it is rejected, from rows of host and base_failed."""
    hosts = judged.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k"))
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("N"), F.sum("k").alias("K"), F.sum(F.col("n").cast("double") * F.col("n")).alias("N2"), F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("KK"))
    mean = F.col("K") / F.col("N").cast("double")
    # moments: between-host variance = (weighted variance of rates - what chance gives) / effective hosts
    spread = F.col("KK") - F.col("N") * mean * mean
    chance = (F.col("hosts") - 1) * mean * (1 - mean)
    between = (spread - chance) / F.nullif(F.col("N") - F.col("N2") / F.col("N"), F.lit(0.0))
    weight = F.when(between > 0, F.greatest(F.lit(LEAST_PRIOR), F.least(F.lit(MOST_PRIOR), mean * (1 - mean) / F.nullif(between, F.lit(0.0)) - 1))).otherwise(F.lit(MOST_PRIOR))
    prior = total.select(mean.alias("mean"), weight.alias("weight"))
    rate = (F.col("k") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    # one row of totals
    return hosts.crossJoin(F.broadcast(prior)).select("host", ((rate > HOST_RATE) & (rate > HOST_TIMES * F.col("mean"))).alias("rejected"))


def host_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each row of docs.

    Null and empty texts have no words and fail. Rows of null source belong to no host and keep their own verdict. Repeated
    rows are counted as often as they stand. A host's rejection rejects its documents; empty tables give no rows. Other
    columns are ignored.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = materialize(base(docs).withColumn("base_failed", failed), "judged")
    rejected = materialize(host_verdicts(judged).where("rejected"), "rejected")
    # a shuffle by host would put a host's documents into one task; beyond the bound AQE splits such a join
    if rejected.count() <= BROADCAST_IDS:
        rejected = F.broadcast(rejected)
    return judged.join(rejected, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"),
    )


def without_failures(docs: DataFrame) -> DataFrame:
    """Rows of docs, unchanged, but for those of a doc_id that host_rules doesn't keep (in any of its rows)."""
    return without_ids(docs, materialize(host_rules(docs).where(~F.col("kept")).select("doc_id"), "failed"))
