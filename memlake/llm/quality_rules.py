"""Quality rules with cross-document line frequency, in DataFrame operations only.

Lines are normalised and hashed; a line that more than ``MAX_DOCS`` documents of one host carry is
boilerplate and removed; a document that loses more than half of its words that way is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.plans.scratch import cut, join_hot, numbered

MAX_DOCS = 50
MIN_WORDS = 50
WINDOW = 3
BLANK = "[\\x20\\x09-\\x0D]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{BLANK}+"), "")


def line_stats(docs: DataFrame, host: str) -> DataFrame:
    """Per row: doc_id, host, the counts of the base rules, and (hash, words) of each line with a word."""
    text = F.coalesce("text", F.lit(""))
    step = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        words_of(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit("[^\\x20\\x09-\\x0D]"))).alias("lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    normal = lambda line: F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, f"{BLANK}+", " ")), "[0-9]+", "0"))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.struct(
            F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")
        ),
    )
    step = step.select(
        "doc_id", "host", "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("lines", lambda line: F.struct(F.xxhash64(normal(line)).alias("h"), F.size(words_of(line)).alias("w"))).alias("lines"),
        F.when(F.size("words") >= WINDOW, F.sort_array(windows)).alias("windows"),
    )
    # windows lie by (hash, place): a repeated one has an equal neighbour
    again = F.filter(
        "windows",
        lambda x, k: (x["h"] == F.get(F.col("windows"), k - 1)["h"]) | (x["h"] == F.get(F.col("windows"), k + 1)["h"]),
    )
    step = step.withColumn("places", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("windows")
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("places"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"), lambda total, x: total + x,
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("places")


def judge_quality(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words).

    base_failed: fewer than 50 words, or more than half of the words lie in three-word windows that
    the text has twice or more.  kept: the base holds, and lines above the limit of their host hold
    no more than half of the words.

    Every row is a document of its host, so repeated rows count as often as they occur.  A null text
    is empty (and fails for want of words); a null host is a host of its own; null ids pass through.
    """
    stats = cut(line_stats(docs, host).withColumn("row", F.monotonically_increasing_id()), "line-stats")
    once = stats.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    above = cut(
        once.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > max_docs).select("host", "h"),
        "above",
    )
    every = stats.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.w")
    removed = join_hot(every, above, ["host", "h"]).groupBy("row").agg(F.sum("w").alias("removed_words"))
    lost = F.coalesce("removed_words", F.lit(0).cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return stats.drop("lines", "host").join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (lost * 2 <= F.col("n_words"))).alias("kept"), lost.alias("removed_words"),
    )


def strip_common_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` with the lines above the limit of their host taken out of ``text``, without depleted documents.

    Lines are those of :func:`judge_quality`, in all their normalised forms; blank lines and the rest of the
    text stay as they are, and so do texts without such a line.  A document that loses more than half of its
    words goes.  All columns are kept; null texts, repeated rows and rows without doc_id are rows like any other.
    """
    rows, key = numbered(docs)
    plain = rows.select(F.col(key).alias("doc_id"), "text", F.col(f"`{host}`").cast("string").alias("host"))
    stats = cut(line_stats(plain, "host").select("doc_id", "host", "n_words", "lines"), "line-stats")
    once = stats.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    above = cut(once.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > max_docs).select("host", "h"), "above")
    every = stats.select("doc_id", "host", F.posexplode("lines").alias("at", "line")).select("doc_id", "host", "at", "line.h", "line.w")
    gone = cut(join_hot(every, above, ["host", "h"]).groupBy("doc_id").agg(F.collect_list("at").alias("gone"), F.sum("w").alias("lost")), "gone")
    lost = stats.select("doc_id", "n_words").join(gone, "doc_id")
    lines = F.split(F.col("text"), "\n")
    # a line's place makes it unlike any other, so one set difference takes out those that go
    placed = F.transform(lines, lambda line, i: F.concat(i.cast("string"), F.lit(":"), line))
    worded = F.filter(placed, lambda line: F.rlike(F.regexp_replace(line, "^[0-9]+:", ""), F.lit("[^\\x20\\x09-\\x0D]")))
    out = F.transform(F.col("__gone"), lambda i: F.get(worded, i))
    kept = F.array_join(F.transform(F.array_except(placed, out), lambda line: F.regexp_replace(line, "^[0-9]+:", "")), "\n")
    columns = [F.when(F.col("__gone").isNotNull(), kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    met = rows.join(lost.select(F.col("doc_id").alias(key), F.col("gone").alias("__gone"), (F.col("lost") * 2 > F.col("n_words")).alias("__depleted")), key, "left")
    return met.where(~F.coalesce("__depleted", F.lit(False))).select(*columns)
