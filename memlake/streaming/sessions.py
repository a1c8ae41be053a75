"""Sessions that gather probes turn by turn, as a stateful stream and as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.functions import text

PROBES = "array<struct<probe:string,turn:int>>"


def _turns(said: DataFrame) -> DataFrame:
    """(session, said_at, probes, reset) of (session, said_at, sentences, query, reset): sentences are probes as
    they are, of a natural query each token is one; a turn without either adds none."""
    whole = F.coalesce(F.filter("sentences", lambda s: s.isNotNull()), F.array().cast("array<string>"))
    tokens = F.coalesce(text.tokens(F.col("query")), F.array().cast("array<string>"))
    return said.select("session", "said_at", F.concat(whole, tokens).alias("probes"), F.coalesce(F.col("reset"), F.lit(False)).alias("reset"))


def gather_batch(said: DataFrame) -> DataFrame:
    """(session, said_at, turn, probes) after every turn of (session, said_at, sentences, query, reset).

    ``probes`` are all of the session so far with their turns, numbered from 0; a reset forgets what came before it and
    adds nothing.  Turns of one session are told apart by said_at.
    """
    along = Window.partitionBy("session").orderBy("said_at")
    rows = _turns(said).withColumn("run", F.sum(F.col("reset").cast("int")).over(along))
    within = Window.partitionBy("session", "run").orderBy("said_at")
    rows = rows.where("not reset").withColumn("turn", F.row_number().over(within) - 1)
    named = F.transform("probes", lambda p: F.struct(p.alias("probe"), F.col("turn").alias("turn")))
    rows = rows.withColumn("probes", F.flatten(F.collect_list(named).over(within.rowsBetween(Window.unboundedPreceding, 0))))
    return rows.select("session", "said_at", "turn", F.col("probes").cast(PROBES).alias("probes"))


def gather_stream(said: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """:func:`gather_batch` over a stream, kept by session across micro-batches.

    A session's turns must come in order of said_at from one micro-batch to the next.  With ``idle_ms`` a
    session that has said nothing for so long is forgotten, and starts anew if it speaks again; its state is
    as long as what it has said.
    """
    kinds = dict(said.dtypes)

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        probes, turns, count = (list(x) if i < 2 else x for i, x in enumerate(state.get)) if state.exists else ([], [], 0)
        said_now = pd.concat(list(frames)).sort_values("said_at")
        out = []
        for at, new, reset in zip(said_now["said_at"], said_now["probes"], said_now["reset"]):
            if reset:
                probes, turns, count = [], [], 0
                continue
            probes, turns = probes + list(new), turns + [count] * len(new)
            out.append((key[0], at, count, [{"probe": p, "turn": t} for p, t in zip(probes, turns)]))
            count += 1
        state.update((probes, turns, count))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session", "said_at", "turn", "probes"])

    return _turns(said).groupBy("session").applyInPandasWithState(
        gather, f"session {kinds['session']}, said_at {kinds['said_at']}, turn int, probes {PROBES}",
        "probes array<string>, turns array<int>, count int", "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
