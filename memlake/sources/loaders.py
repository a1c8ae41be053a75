"""Loaders: claims, long conversations and repository logs as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLAIM = "id string, text string, valid_from bigint, supersedes string"
TURN = "struct<role: string, content: string>"


def claims_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One claim per line; a malformed line fails the read."""
    return spark.read.schema(CLAIM).option("mode", "FAILFAST").json(path)


def long_memory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, claims) of records with parallel arrays of sessions, ids and dates.

    A claim is one turn, ``<question>-s<i>-t<j>``, at its session's epoch plus j.
    """
    schema = f"""question_id string, question_type string, question string, answer string, haystack_session_ids array<string>,
        haystack_dates array<string>, haystack_sessions array<array<{TURN}>>, answer_session_ids array<string>"""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    sessions = rows.select("question_id", "haystack_dates", "haystack_session_ids", F.posexplode("haystack_sessions").alias("s", "turns"))
    turns = sessions.select("question_id", "s", "haystack_dates", "haystack_session_ids", F.posexplode("turns").alias("t", "turn"))
    at = F.unix_millis(F.to_timestamp(F.regexp_replace(F.get("haystack_dates", F.col("s")), r"\s*\([A-Za-z]+\)", ""), "yyyy/MM/dd HH:mm"))
    claims = turns.select(
        F.format_string("%s-s%d-t%d", "question_id", "s", "t").alias("id"), F.col("turn.content").alias("text"), F.col("turn.role").alias("role"),
        (at + F.col("t")).alias("valid_from"), "question_id", F.get("haystack_session_ids", F.col("s")).alias("session_id"),
    )
    return rows.drop("haystack_sessions", "haystack_dates", "haystack_session_ids"), claims


def long_dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, turns) of samples whose sessions are keys ``session_<n>`` beside ``session_<n>_date_time``.

    A turn without text takes its image caption and goes if it has neither; a question without an
    answer is adversarial.
    """
    schema = """sample_id string, conversation map<string, string>,
        qa array<struct<question: string, answer: string, adversarial_answer: string, category: int, evidence: array<string>>>"""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    pairs = rows.select("sample_id", F.col("conversation").alias("all"), F.explode("conversation").alias("key", "value"))
    sessions = pairs.where(F.col("key").rlike("^session_[0-9]+$")).select(
        "sample_id", F.regexp_extract("key", "([0-9]+)$", 1).cast("int").alias("session"),
        F.element_at("all", F.concat("key", F.lit("_date_time"))).alias("date_time"),
        F.from_json("value", "array<struct<speaker: string, dia_id: string, text: string, blip_caption: string>>").alias("turns"),
    )
    turns = sessions.select("sample_id", "session", "date_time", F.posexplode("turns").alias("place", "turn")).select(
        F.concat_ws("-", "sample_id", "turn.dia_id").alias("id"), "sample_id", "session", "date_time", "place",
        F.col("turn.speaker").alias("speaker"), F.coalesce(F.nullif(F.col("turn.text"), F.lit("")), F.col("turn.blip_caption")).alias("text"),
    ).where("text is not null")
    questions = rows.select("sample_id", F.posexplode("qa").alias("place", "q")).select(
        "sample_id", "place", "q.*", F.col("q.answer").isNull().alias("adversarial")
    )
    return questions, turns


def session_rows(rows: DataFrame) -> DataFrame:
    """Turns of (dialogue_id, session_id, dialogue[], speaker[]): ids ``<dialogue>-s<k>-t<j>`` at k * 10^6 + j."""
    order = Window.partitionBy("dialogue_id").orderBy("session_id")
    placed = rows.withColumn("k", F.row_number().over(order) - 1)
    return placed.select("dialogue_id", "k", F.posexplode(F.arrays_zip("dialogue", "speaker")).alias("j", "turn")).select(
        F.format_string("%s-s%d-t%d", F.col("dialogue_id").cast("string"), "k", "j").alias("id"), "dialogue_id", "k", "j",
        F.col("turn.dialogue").alias("text"), F.col("turn.speaker").alias("speaker"), (F.col("k") * 1_000_000 + F.col("j")).cast("bigint").alias("valid_from"),
    )


def paragraphs(docs: DataFrame, size: int = 6000) -> DataFrame:
    """(id, chunk, text): paragraphs packed, in order, into chunks of at most ``size`` characters; a longer
    paragraph is a chunk of its own."""
    folded = F.aggregate(
        F.filter(F.split("text", r"\n\s*\n"), lambda p: F.trim(p) != ""),
        F.array().cast("array<string>"),
        lambda done, p: F.when(
            (F.size(done) > 0) & (F.length(F.element_at(done, -1)) + F.length(p) + 2 <= size),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws("\n\n", F.element_at(done, -1), p))),
        ).otherwise(F.array_append(done, p)),
    )
    return docs.select("id", F.posexplode(folded).alias("chunk", "text"))


def git_log(lines: DataFrame) -> DataFrame:
    """(hash, author, at, subject, status, path) of ``git log --name-status --format='commit %H|%an|%ct|%s'``.

    ``lines(file, n, value)``: numbered lines of each log file; a file line belongs to the header above.
    """
    head = F.col("value").startswith("commit ")
    above = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("header", F.last(F.when(head, F.substring("value", 8, 1 << 30)), ignorenulls=True).over(above))
    parts = F.split("header", r"\|", 4)
    return rows.where(~head & (F.trim("value") != "") & F.col("header").isNotNull()).select(
        F.get(parts, F.lit(0)).alias("hash"), F.get(parts, F.lit(1)).alias("author"), (F.get(parts, F.lit(2)).cast("bigint") * 1000).alias("at"),
        F.get(parts, F.lit(3)).alias("subject"), F.substring(F.get(F.split("value", "\t"), F.lit(0)), 1, 1).alias("status"),
        F.element_at(F.split("value", "\t"), -1).alias("path"),
    )


def file_tree(spark: SparkSession, root: str, depth: int = 4, ignore: Sequence[str] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """(path, parent, is_dir) below a checkout on the driver."""
    out: list[tuple[str, str, bool]] = []
    for folder, dirs, files in os.walk(root):
        at = os.path.relpath(folder, root)
        level = 0 if at == "." else at.count("/") + 1
        dirs[:] = sorted(d for d in dirs if d not in ignore) if level < depth else []
        name = (lambda x: x) if at == "." else (lambda x: f"{at}/{x}")
        out += [(name(d), at, True) for d in dirs] + [(name(f), at, False) for f in sorted(files)]
    return spark.createDataFrame(out, "path string, parent string, is_dir boolean")


def load_prompt(folder: str, name: str, snippets: str) -> str:
    """The text ``<folder>/<name>.md``, where a line ``@include x`` stands for ``<snippets>/x.md``; once, so
    an include within a snippet stays as it is."""
    import re
    from pathlib import Path

    read = lambda *parts: Path(*parts).read_text(encoding="utf-8").strip()
    return re.sub(r"(?m)^@include[ \t]+(\S+)[ \t]*$", lambda m: read(snippets, f"{m[1]}.md"), read(folder, f"{name}.md"))
