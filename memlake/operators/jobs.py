"""Maintenance jobs as ordinary queries: promote, prune, consolidate, merge, drift, tune."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scoring, text

# Parts of file names that hint at a rule of the business.
BUSINESS_HINTS = ("enum", "status", "state", "type", "role", "permission", "policy")


def number_messages(rows: DataFrame, existing: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``message_index``: the row's place in its session, after the ``n`` messages already there."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.join(existing, list(by), "left").withColumn("message_index", place + F.coalesce("n", F.lit(0))).drop("n")


def promote_working(turns: DataFrame, by: Sequence[str], now_ms: int, max_age_ms: int = scoring.DAY_MS, capacity: int = 50) -> DataFrame:
    """Working-layer rows to promote: older than ``max_age_ms``, or the oldest beyond a session's capacity."""
    session = Window.partitionBy(*by)
    place = F.row_number().over(session.orderBy("created_at", *([c for c in ("turn", "id") if c in turns.columns])))
    rows = turns.withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(session))
    return rows.where(((F.lit(now_ms) - F.col("created_at")) > max_age_ms) | (F.col("place") <= F.col("n") - capacity))


def prune_decayed(rows: DataFrame, now_ms: int, rate: float, threshold: float = 0.05) -> DataFrame:
    """Rows (weight, created_at, invalid_at) whose decayed weight is under the threshold; invalidated ones are skipped."""
    left = F.round(scoring.decay(F.col("weight"), F.col("created_at"), now_ms, rate), 6)
    return rows.where("invalid_at is null").withColumn("decayed", left).where(F.col("decayed") < threshold)


def profile_sources(about: DataFrame, memory: DataFrame, owned: DataFrame, domain: str, now_ms: int) -> DataFrame:
    """(user, contents): the texts about each user (in_id about out_id), oldest first, without those that
    the domain holds as superseded or expired; texts that it does not own count."""
    mine = owned.where(F.col("out_id") == f"domain:{domain}").groupBy(F.col("in_id").alias("id")).agg(F.min("attributes").alias("attributes"))
    rows = about.select(F.col("in_id").alias("id"), F.col("out_id").alias("user")).distinct().join(memory.select("id", "content", "created_at"), "id").join(mine, "id", "left")
    until = F.get_json_object("attributes", "$.validUntil").cast("bigint")
    gone = F.coalesce(F.get_json_object("attributes", "$.superseded") == "true", F.lit(False)) | F.coalesce(until < now_ms, F.lit(False))
    texts = F.array_sort(F.collect_list(F.struct("created_at", "id", "content")))
    return rows.where(~gone).groupBy("user").agg(F.transform(texts, lambda x: x["content"]).alias("contents"))


def consolidate_profiles(sources: DataFrame, existing: DataFrame, summarise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(user, id, content): a summary of each user's texts by ``summarise`` (user, contents -> user, content).

    ``id`` is the summary that is there already (``existing``: in_id about out_id, the least), null for a
    new one; blank summaries are left out.
    """
    known = existing.groupBy(F.col("out_id").alias("user")).agg(F.min("in_id").alias("id"))
    made = summarise(sources).select("user", "content").where(F.length(F.trim("content")) > 0)
    return made.join(known, "user", "left").select("user", "id", "content")


def scan_commits(files: DataFrame, modules: DataFrame | None = None, listed: int = 10, asked: int = 5) -> tuple[DataFrame, DataFrame]:
    """(modules, notes) of changed files (place, status, path), the newest commit first.

    modules: (path, name, kind, status) of folders with added files and no deleted ones as ``active``, and
    of folders with deleted files, where ``modules(path)`` are known those alone, as ``archived``.  notes:
    (topic, n, listing) of new folders, removed ones and added files whose name hints at a rule of the
    business, with the first few named.  Files at the top belong to no folder.
    """
    parts = files.select("place", "status", "path", F.split("path", "/").alias("parts"))
    foldered = parts.where(F.size("parts") > 1).withColumn("folder", F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/"))
    seen = foldered.where(F.col("status").isin("A", "D")).groupBy("folder").agg(
        F.count_if(F.col("status") == "A").alias("added"), F.count_if(F.col("status") == "D").alias("gone"), F.min("place").alias("place")
    )
    state = F.when(F.col("gone") == 0, "active").otherwise("archived")
    found = seen.select(F.col("folder").alias("path"), F.substring_index("folder", "/", -1).alias("name"), text.module_kind(F.col("folder")).alias("kind"), state.alias("status"), "place")
    kept = found if modules is None else found.where("status = 'active'").unionByName(found.where("status = 'archived'").join(modules.select("path"), "path", "left_semi").select(*found.columns))
    hints = parts.where((F.col("status") == "A") & F.lower(F.element_at("parts", -1)).rlike("|".join(BUSINESS_HINTS)))
    rows = found.select(F.when(F.col("status") == "active", "new folders").otherwise("removed folders").alias("topic"), "place", "path").unionByName(
        hints.select(F.lit("business").alias("topic"), "place", "path")
    )
    named = None
    for topic, most in (("new folders", listed), ("removed folders", listed), ("business", asked)):
        part = rows.where(F.col("topic") == topic).orderBy("place", "path").limit(most)
        named = part if named is None else named.unionByName(part)
    first = named.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]), ", ").alias("listing"))
    notes = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).join(first, "topic")
    return kept.drop("place"), notes


def drift(decisions: DataFrame, listing: DataFrame) -> DataFrame:
    """Decisions (id, path) about paths that are no longer in the listing (path)."""
    return decisions.join(listing, "path", "left_anti")


def backfill(rows: DataFrame, **values: Column) -> DataFrame:
    """Fill null columns from expressions; what is set stays."""
    return rows.withColumns({name: F.coalesce(F.col(name), value) for name, value in values.items()})


def tune(evaluate: Callable[[Mapping[str, float]], float], ranges: Mapping[str, tuple[float, float, float, float]], most: int = 50) -> tuple[dict[str, float], float]:
    """Coordinate hill climb over (start, low, high, step): the first step that improves is taken.

    Each evaluation is a Spark job of the caller's; at most ``most`` are run.
    """
    now = {k: v[0] for k, v in ranges.items()}
    best, runs, improved = evaluate(now), 1, True
    while improved and runs < most:
        improved = False
        for name, (_, low, high, step) in ranges.items():
            for sign in (1, -1):
                trial = {**now, name: min(high, max(low, now[name] + sign * step))}
                if trial == now or runs >= most:
                    continue
                runs += 1
                if (value := evaluate(trial)) > best:
                    now, best, improved = trial, value, True
                    break
            if improved:
                break
    return now, best


def due_schedules(schedules: DataFrame, now_ms: int) -> DataFrame:
    """Schedules (domain, schedule_id, interval_ms, last_run) whose interval has passed; a null last_run is due."""
    return schedules.where(F.col("last_run").isNull() | (F.lit(now_ms) - F.col("last_run") >= F.col("interval_ms")))
