"""Sessions over a stream equal those over a batch."""

from memlake.streaming import sessions

SAID = "session string, said_at bigint, sentences array<string>, query string, reset boolean"


def test_two_interleaved_sessions(spark, tmp_path):
    turns = [
        [("a", 1, ["first thing"], None, None), ("b", 1, None, "where was Bob born", False), ("a", 2, None, "red green", None)],
        [("b", 2, ["x", None, "y"], None, None), ("a", 3, [], None, None), ("a", 4, None, None, True)],
        [("a", 5, ["anew"], None, None), ("b", 3, ["z"], "blue", None), ("c", 1, None, None, None)],
    ]
    for k, part in enumerate(turns):
        spark.createDataFrame(part, SAID).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SAID).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = sessions.gather_stream(stream).writeStream.format("memory").queryName("gathered").outputMode("append").option(
        "checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    plain = lambda rows: sorted((r["session"], r["said_at"], r["turn"], tuple(map(tuple, r["probes"]))) for r in rows)
    found = plain(spark.sql("select * from gathered").collect())
    assert found == plain(sessions.gather_batch(spark.createDataFrame([r for p in turns for r in p], SAID)).collect())
    by_turn = {(s, at): (turn, probes) for s, at, turn, probes in found}
    assert by_turn["a", 3] == (2, (("first thing", 0), ("red", 1), ("green", 1))) and by_turn["a", 5] == (0, (("anew", 0),))
    assert by_turn["b", 3][1][-4:] == (("x", 1), ("y", 1), ("z", 2), ("blue", 2)) and by_turn["c", 1] == (0, ())
    assert ("a", 4) not in by_turn
