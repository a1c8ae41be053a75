"""Functions, store, engine, sources and streams on hand-made rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake import commands, model
from memlake.engine import Domain, Engine, Plugin
from memlake.functions import scoring, text, vector
from memlake.operators import enrich, evaluate, filters, graph, ingest, jobs, paths, retrieval, search, sequence
from memlake.operators.store import Store
from memlake.sources import connect, loaders
from memlake.streaming import inbox


def one(spark, column):
    return spark.range(1).select(column).collect()[0][0]


@pytest.mark.parametrize(
    "v, f, g, penalize, expected",
    [(None, 0.8, 0.6, False, 0.72), (None, None, None, False, 0.0), (0.9, None, None, False, 0.9), (1.0, 0.5, 0.0, False, 0.65),
     (None, 1.0, None, True, 0.3), (0.6, 0.5, None, True, 0.45), (None, 1.0, None, False, 1.0)],
)
def test_merge_scores(spark, v, f, g, penalize, expected):
    columns = {k: F.lit(x).cast("double") for k, x in zip(("vector", "fulltext", "graph"), (v, f, g))}
    assert one(spark, scoring.merge_scores(columns, penalize_missing=penalize)) == pytest.approx(expected)


def test_merge_scores_without_weights(spark):
    assert one(spark, scoring.merge_scores({"vector": F.lit(0.5)}, {"vector": 0.0})) == 0.0


def test_cosine(spark):
    rng = np.random.default_rng(0)
    pairs = [(rng.normal(size=8).tolist(), rng.normal(size=8).tolist()) for _ in range(20)] + [([0.0] * 8, [1.0] * 8), ([1.0], [1.0, 2.0])]
    rows = spark.createDataFrame(pairs, "a array<double>, b array<double>").select(vector.cosine(F.col("a"), F.col("b"))).collect()
    for (a, b), r in zip(pairs, rows):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        assert r[0] == pytest.approx(np.dot(a, b) / size if len(a) == len(b) and size else 0.0, abs=1e-9)


def test_decay_and_rank(spark):
    assert one(spark, scoring.decay(F.lit(1.0), F.lit(0), 3_600_000, 0.5)) == pytest.approx(math.exp(-0.5))
    assert one(spark, scoring.decay(F.lit(0.0), F.lit(0), 10**9, 0.5)) == 0.0
    assert one(spark, scoring.domain_rank(F.lit(1.0), F.lit(False), F.lit(0.9))) == pytest.approx(0.05)
    assert one(spark, scoring.domain_rank(F.lit(1.0), F.lit(True), F.lit(0.9))) == pytest.approx(1.2)
    assert one(spark, scoring.temporal_weight(F.lit(5), None)) == 1.0


def test_text_functions(spark):
    t = F.lit("The Cats' quick-brown fox, AND the 2 dogs!")
    assert one(spark, text.tokens(t)) == ["the", "cats", "quick", "brown", "fox", "and", "the", "2", "dogs"]
    assert one(spark, text.matches_all(t, "FOX the")) and not one(spark, text.matches_all(t, "fox cow")) and not one(spark, text.matches_all(t, " "))
    assert one(spark, text.keywords(t)) == ["cats", "quick-brown", "fox", "dogs"]
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, text.kebab(F.lit("myModule Name_x"))) == "my-module-name-x"
    assert one(spark, text.tag_id(F.lit("tag:a"))) == "tag:a" and one(spark, text.topic_name(F.lit("  AbC "))) == "abc"
    assert json.loads(one(spark, text.json_block(F.lit('ok ```json\n{"a": 1}\n``` end')))) == {"a": 1}
    assert json.loads(one(spark, text.json_block(F.lit("x [1, 2] y")))) == [1, 2]
    assert one(spark, text.error_class(F.lit("Rate limit reached"))) == "transient"
    assert one(spark, text.error_class(F.lit("502 Bad Gateway"))) == "transient"
    assert one(spark, text.error_class(F.lit("no such table"))) == "permanent"
    assert one(spark, text.error_class(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, text.timestamp_flag(F.lit("123"))) == 123 and one(spark, text.timestamp_flag(F.lit("1970-01-01 00:00:01"))) == 1000
    assert one(spark, text.timestamp_flag(F.lit("soon"))) is None
    assert one(spark, text.stable_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))) == '{"a":2,"b":1}'


def test_schema_registry():
    registry = model.SchemaRegistry()
    registry.register("thing", {"id": "string", "n": "option<int>"}, required=("id", "n"))
    registry.register("thing", {"v": "vector(3)", "odd": "whatever"})
    with pytest.raises(model.SchemaConflict):
        registry.register("thing", {"n": "string"})
    with pytest.raises(ValueError):
        registry.register("thing", {"no good": "string"})
    fields = {f.name: f for f in registry.schema("thing")}
    assert not fields["id"].nullable and fields["n"].nullable and fields["v"].dataType.simpleString() == "array<float>"


MEMORY = "id string, content string, embedding array<float>, event_time bigint, created_at bigint, token_count bigint"
ROWS = [("memory:1", "red apple pie", [1.0, 0.0, 0.0], 10, 1, 3), ("memory:2", "green apple", [0.8, 0.6, 0.0], None, 2, 2), ("memory:3", "blue sea", [0.0, 1.0, 0.0], 30, 3, 2), ("memory:4", "nothing", None, 40, 4, 9)]


@pytest.fixture(scope="module")
def corpus(spark):
    edges = lambda *pairs: spark.createDataFrame(list(pairs), "in_id string, out_id string")
    owned = spark.createDataFrame([("memory:1", "domain:a", "{}"), ("memory:2", "domain:b", "{}"), ("memory:3", "domain:a", "{}")], "in_id string, out_id string, attributes string")
    refs = spark.createDataFrame([("memory:1", "memory:2", "refines")], "in_id string, out_id string, edge_type string")
    tagged = edges(("memory:1", "tag:x"), ("memory:3", "tag:y"), ("memory:3", "tag:x"))
    return search.Corpus(spark.createDataFrame(ROWS, MEMORY), tagged, owned, refs, {"about": edges(("memory:2", "topic:t"), ("memory:3", "topic:t"))})


def ids(frame):
    return [r.id for r in frame.collect()]


def test_search_modes(corpus):
    q = search.SearchQuery
    assert ids(search.search(corpus, q(mode="vector", vector=[1, 0, 0], limit=2))) == ["memory:1", "memory:2"]
    assert set(ids(search.search(corpus, q(mode="fulltext", text="apple")))) == {"memory:1", "memory:2"}
    fallback = search.search(corpus, q(mode="fulltext", text="gree sea")).collect()
    assert {r.id for r in fallback} == {"memory:2", "memory:3"} and all(r.score == 0.3 for r in fallback)
    assert set(ids(search.search(corpus, q(mode="graph", tags=["tag:x"])))) == {"memory:1", "memory:3"}
    assert set(ids(search.search(corpus, q(mode="graph", traversal="<-about<-memory", start=["topic:t"])))) == {"memory:2", "memory:3"}
    with pytest.raises(ValueError):
        search.parse_hop("->a->b->c")
    top = search.search(corpus, q(vector=[1, 0, 0], text="red apple", tags=["tag:x"])).collect()[0]
    assert top.id == "memory:1" and None not in (top.vector, top.fulltext, top.graph)
    assert ids(search.search(corpus, q(mode="vector", vector=[1, 0, 0], domains=["domain:b"]))) == ["memory:2"]
    assert ids(search.search(corpus, q(mode="vector", vector=[1, 0, 0], ids=["3"]))) == ["memory:3"]
    assert ids(search.search(corpus, q(mode="vector", vector=[1, 0, 0], before=10))) == ["memory:1"]
    assert ids(search.search(corpus, q(mode="vector", vector=None))) == []
    assert ids(search.search(corpus, q(mode="vector", vector=[1, 0, 0], token_budget=4))) == ["memory:1"]
    assert ids(search.search(corpus, q(mode="fulltext", text="apple", vector=[1, 0, 0], rerank=0.9))) == ["memory:1"]
    assert ids(search.engine_search(corpus, q(mode="vector", vector=[1, 0, 0]), visible=["domain:a"])) == ["memory:1", "memory:3"]


def test_enrichment(corpus):
    rows = corpus.memory.select("id")
    assert {r.id: r.tags for r in search.hydrate_tags(rows, corpus.tagged).collect()}["memory:3"] == ["x", "y"]
    refs = {r.id: r.references for r in search.enrich_connections(rows, corpus.references).collect()}
    assert refs["memory:2"][0].far == "memory:1" and refs["memory:4"] is None
    assert {r.id: r.domains for r in search.enrich_domains(rows, corpus.owned).collect()}["memory:1"] == {"a": "{}"}


def test_budgets_stop_or_skip(spark):
    rows = spark.createDataFrame([("a", 0.9, 10), ("b", 0.8, 20), ("c", 0.7, 5)], "id string, score double, token_count bigint")
    assert ids(search.token_budget(rows, 15)) == ["a"] and sorted(ids(retrieval.budget_skipping(rows, 15))) == ["a", "c"]
    assert ids(search.token_budget(rows, 9)) == []
    vectors = rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    assert sorted(ids(retrieval.mmr_fill(vectors, 15, 1.0))) == sorted(ids(retrieval.budget_skipping(rows, 15)))


def test_mmr_prefers_the_different(spark):
    rows = spark.createDataFrame([("a", 1.0, 1, [1.0, 0.0]), ("b", 0.9, 1, [1.0, 0.0]), ("c", 0.5, 1, [0.0, 1.0])], "id string, score double, token_count bigint, embedding array<double>")
    assert [r.id for r in retrieval.mmr_fill(rows, 2, 0.5).orderBy("place").collect()] == ["a", "c"]


def test_identities(spark):
    rng = np.random.default_rng(3)
    claims = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "id bigint, embedding array<double>")
    probes = claims.where("id < 3").select(F.col("id").alias("probe"), F.lit(1.0).alias("weight"), "embedding")
    scored = paths.probe_scores(claims, probes)
    mass = claims.select("id", (F.col("id") + 1.0).alias("mass"))
    key = lambda f: sorted(map(str, f.collect()))
    assert key(paths.idf_mass_anchor(scored, mass, 0.0).select("probe", "id", "sim")) == key(paths.per_probe_top(scored).select("probe", "id", "sim"))
    assert key(paths.density(scored, exponent=1.0)) == key(paths.idf_fusion(scored, mass, 0.0))
    seeds = claims.where("id < 2").select("id", F.lit(1.0).alias("activation"))
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src bigint, dst bigint, weight double")
    assert key(paths.spread_activation(edges, seeds, hops=0)) == key(seeds)
    assert {r.weight for r in paths.session_weights(spark.createDataFrame([(1, 0), (1, 5)], "session int, turn int"), None).collect()} == {1.0}


def test_shortest_paths_equal_dijkstra(spark):
    import heapq

    rng = np.random.default_rng(5)
    edges = {(int(a), int(b)): round(float(rng.random()), 3) for a, b in rng.integers(0, 15, (40, 2)) if a < b}
    frame = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "src bigint, dst bigint, cost double")
    near = {}
    for (a, b), c in edges.items():
        near.setdefault(a, []).append((b, c))
        near.setdefault(b, []).append((a, c))
    best, queue = {}, [(0.0, 0)]
    while queue:
        cost, node = heapq.heappop(queue)
        if node not in best:
            best[node] = cost
            for other, c in near.get(node, []):
                heapq.heappush(queue, (cost + c, other))
    found = {r.id: r.cost for r in paths.shortest_paths(frame, spark.createDataFrame([(0,)], "id bigint"), 14).collect()}
    assert found == pytest.approx(best)


def test_traverse_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "in_id string, out_id string")
    found = {r.id: r.depth for r in graph.traverse(edges, spark.createDataFrame([("a",)], "id string"), 9).collect()}
    assert found == {"b": 1, "c": 1, "d": 2}
    assert sorted(ids(graph.tag_descendants(edges, "d"))) == ["a", "b", "c"]


def test_semantic_edges_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(150, 6))
    m[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "id bigint, embedding array<double>")
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if round(float(u[a] @ u[b]), 6) >= 0.65}
    assert {(r.a, r.b) for r in graph.semantic_edges(rows, 0.65).collect()} == want and want


def test_segmentation():
    m = np.vstack([np.tile([1.0, 0.0], (5, 1)), np.tile([0.0, 1.0], (4, 1)), np.tile([1.0, 1.0], (6, 1))])
    assert sequence.segment_optimally(m, 3) == ([5, 9], 3, pytest.approx(0.0))
    # a segment costs ln(15): one cut leaves 2.4 + 2 ln 15 = 7.82, two cuts leave 3 ln 15 = 8.12
    assert sequence.segment_optimally(m)[0] == [5]
    assert sequence.segment_optimally(np.zeros((0, 2))) == ([], 0, 0.0)


def test_boundaries_and_rollup(spark):
    rows = spark.createDataFrame([(1, [5, 9], [6, 20]), (2, [], [3])], "id bigint, predicted array<int>, gold array<int>")
    counts = evaluate.boundary_counts(rows)
    assert sorted(map(tuple, counts.collect())) == [(1, 1, 1, 1), (2, 0, 0, 1)]
    assert tuple(evaluate.micro_average(counts).collect()[0]) == (0.5, pytest.approx(0.333333), 0.4)
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, id string, rank int")
    ideal = spark.createDataFrame([("q", "a"), ("q", "z")], "query string, id string")
    assert evaluate.set_f1_at_ideal(ranked, ideal).collect()[0].f1 == 0.5


def test_ingest_jobs_and_ledger(spark):
    corpus = spark.createDataFrame([("m1", [1.0, 0.0]), ("m2", [0.0, 1.0])], "id string, embedding array<double>")
    batch = spark.createDataFrame([("b1", [1.0, 0.0]), ("b2", [0.9, 0.44]), ("b3", [-1.0, 0.0]), ("b4", None)], "id string, embedding array<double>")
    assert {r.id: r.route for r in ingest.route(batch, corpus).collect()} == {"b1": "skip", "b2": "reinforce", "b3": "store", "b4": "store"}
    claims = spark.createDataFrame([("a", 1, None), ("b", 5, "a"), ("c", 9, "b"), ("d", 9, "zz"), ("e", 7, "a")], "id string, valid_from bigint, supersedes string")
    assert {r.id: r.valid_to for r in ingest.supersede(claims).collect()} == {"a": 5, "b": 9, "c": None, "d": None, "e": None}
    assert {r.id: r.problem for r in ingest.supersession_errors(claims).collect()} == {"d": "unknown", "e": "already closed"}
    best, value = jobs.tune(lambda p: -((p["x"] - 3) ** 2), {"x": (0, -5, 5, 1)})
    assert best == {"x": 3} and value == 0
    due = spark.createDataFrame([("d", "a", 10, None), ("d", "b", 10, 95), ("d", "c", 10, 90)], "domain string, schedule_id string, interval_ms bigint, last_run bigint")
    assert sorted(r.schedule_id for r in jobs.due_schedules(due, 100).collect()) == ["a", "c"]


def test_validity_and_audience(spark):
    rows = spark.createDataFrame([(1, None), (2, '{"superseded": true}'), (3, '{"validUntil": 5}'), (4, '{"validUntil": 50, "audience": ["x"]}'), (5, '{"audience": "x"}')], "id bigint, attributes string")
    assert ids(rows.where(filters.still_valid(F.col("attributes"), 10))) == [1, 4, 5]
    assert ids(rows.where(filters.audience_matches(F.col("attributes"), "x"))) == [4, 5]
    assert filters.field_filter("a", {"odd": 1}) is None and filters.field_filter("a", None) is None


def test_enrichment_stages(spark):
    mentions = spark.createDataFrame([("m1", " Alpha ", None), ("m2", "beta", "topic:b"), ("m3", "New", None), ("m4", "new ", None)], "id string, name string, topic_id string")
    links, fresh = enrich.link_topics(mentions, spark.createDataFrame([("topic:a", "alpha")], "id string, name string"))
    out = {r.in_id: r.out_id for r in links.collect()}
    assert out["m1"] == "topic:a" and out["m2"] == "topic:b" and out["m3"] == out["m4"] and fresh.count() == 1
    rows = spark.createDataFrame([("m1", "long", 200), ("m2", "short", 5)], "id string, content string, token_count bigint")
    split = lambda some: some.select("id", F.array(F.lit("one"), F.lit("two")).alias("facts"))
    marked, children = enrich.decompose(rows, 100, split)
    assert {r.id: r.decomposed for r in marked.collect()} == {"m1": True, "m2": False} and sorted(ids(children)) == ["m1/0", "m1/1"]
    assert enrich.decompose(rows, 100)[1].count() == 0
    nodes = spark.createDataFrame([("MyApp", "app"), ("my-app", "app"), ("lib", "library")], "name string, kind string")
    relations = spark.createDataFrame([("MyApp", "lib", "uses"), ("lib", "lib", "uses"), ("lib", "gone", "uses")], "src string, dst string, relationship string")
    once, kept = enrich.validate_graph(nodes, relations)
    assert once.count() == 2 and [tuple(r) for r in kept.collect()] == [("my-app", "lib", "uses")]


def test_store_transactions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("tag:a", "a"), ("tag:b", "b")], "id string, label string")
    store.create("tag", rows)
    with pytest.raises(ValueError):
        store.create("tag", rows)
    store.create("tag", rows.unionByName(spark.createDataFrame([("tag:c", "c")], rows.schema)), ignore=True)
    store.update("tag", spark.createDataFrame([("tag:a", "A")], rows.schema))
    assert sorted(r.label for r in store.read("tag").collect()) == ["A", "b", "c"]

    def fails(s):
        s.delete(["tag:a"])
        raise RuntimeError

    with pytest.raises(RuntimeError):
        store.transaction(fails)
    assert store.read("tag").count() == 3
    pair = spark.createDataFrame([("tag:a", "tag:b")], "in_id string, out_id string")
    store.relate("child_of", pair)
    store.relate("child_of", pair)
    assert store.read("edges").count() == 1
    store.unrelate("child_of")
    assert store.read("edges").count() == 1
    store.unrelate("child_of", out_id="tag:b")
    assert store.read("edges").count() == 0


def embed(content):
    return [float("red" in content), float("blue" in content), 0.1]


def test_engine_and_commands(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "engine"), embed)
    with pytest.raises(ValueError):
        engine.register(Domain("needy", requires=["absent"]))
    engine.use(Plugin("p"))
    ran = []
    engine.register(Domain("kb", auto_own=True, schedules={"s": (10, lambda e: ran.append(1))}, tables={"t": lambda e, p: e.store.read("memory").select("id")}))
    engine.register(Domain("log", access="read"))
    first = commands.dispatch(engine, ["write", "red house", "blue sea", "--tags", "colour/warm"])
    assert first["ok"], first
    red, blue = first["result"]
    assert engine.ingest(["red house"]) == {"red house": "skip"}
    found = commands.dispatch(engine, ["search", "red", "--limit", "1"])["result"].collect()
    assert [r.id for r in found] == [red]
    assert sorted(r.label for r in engine.tags(red).collect()) == ["warm"]
    engine.pin(blue, "kb")
    assert ids(engine.core_memories("kb")) == [blue]
    engine.update(red, attributes={"importance": 1})
    attributes = engine._edges("owned_by").where(F.col("in_id") == red).collect()[0].attributes
    assert json.loads(attributes)["importance"] == "1"
    engine.relate(red, "refines", blue)
    assert ids(engine.traverse(red, ["refines"])) == [blue]
    assert "red house" in engine.build_context(search.SearchQuery(vector=embed("red"), text="red", domains=["domain:kb"])).collect()[0].context
    assert engine.run_due(100) and not engine.run_due(105) and ran == [1]
    engine.release(red, "kb")
    assert ids(engine.search_table("kb", "t")) == [blue]
    assert engine.store.read("edges").where((F.col("in_id") == red) | (F.col("out_id") == red)).count() == 0
    assert not commands.dispatch(engine, ["write", "x"], read_only=True)["ok"]
    assert not commands.dispatch(engine, ["no-such"])["ok"]
    assert "| id |" in commands.dispatch(engine, ["search-table", "kb", "t", "--format", "markdown"])["result"]


def test_flags():
    call = commands.parse(["a", "--x", "1", "--y=2", "--x", "3", "--z", "--w=a,b"])
    assert call.words == ["a"] and call.flags == {"x": ["1", "3"], "y": "2", "z": True, "w": "a,b"} and call.list("w") == ["a", "b"]


def test_sources(spark, tmp_path):
    assert connect.parse_connection("postgres://h/d").location == "jdbc:postgresql://h/d"
    assert connect.parse_connection("s3://b/k").location == "s3a://b/k" and connect.parse_connection("dir:///x").read_only
    with pytest.raises(PermissionError):
        connect.write_table(spark.range(1), connect.parse_connection("dir:///x"), "t")
    here = connect.parse_connection(str(tmp_path))
    connect.write_table(spark.range(3), here, "t")
    assert connect.read_table(spark, here, "t").count() == 3
    assert connect.query(spark, "select :x + 1 as y", {"x": 1}).collect()[0].y == 2
    (tmp_path / "claims.jsonl").write_text('{"id": "a", "text": "t", "valid_from": 1}\n')
    assert loaders.claims_jsonl(spark, str(tmp_path / "claims.jsonl")).collect()[0].supersedes is None
    sample = [{"sample_id": "s", "conversation": {"session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hi"}, {"speaker": "B", "dia_id": "D1:2", "blip_caption": "cat"}, {"speaker": "B", "dia_id": "D1:3"}], "session_1_date_time": "now"}, "qa": [{"question": "q", "category": 5}]}]
    (tmp_path / "dialogues.json").write_text(json.dumps(sample))
    questions, turns = loaders.long_dialogues(spark, str(tmp_path / "dialogues.json"))
    assert questions.collect()[0].adversarial and [r.text for r in turns.orderBy("place").collect()] == ["hi", "cat"]
    memory = [{"question_id": "q1", "question": "?", "answer": "a", "haystack_session_ids": ["s0"], "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_sessions": [[{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]]}]
    (tmp_path / "memory.json").write_text(json.dumps(memory))
    _, claims = loaders.long_memory(spark, str(tmp_path / "memory.json"))
    assert [(r.id, r.valid_from) for r in claims.orderBy("id").collect()] == [("q1-s0-t0", 1684549260000), ("q1-s0-t1", 1684549260001)]
    rows = spark.createDataFrame([(7, 2, ["c"], ["A"]), (7, 1, ["a", "b"], ["A", "B"])], "dialogue_id bigint, session_id int, dialogue array<string>, speaker array<string>")
    assert [(r.id, r.valid_from) for r in loaders.session_rows(rows).orderBy("valid_from").collect()] == [("7-s0-t0", 0), ("7-s0-t1", 1), ("7-s1-t0", 1_000_000)]
    long = spark.createDataFrame([("d", "aa\n\nbb\n\n" + "c" * 12)], "id string, text string")
    assert [r.text for r in loaders.paragraphs(long, 8).orderBy("chunk").collect()] == ["aa\n\nbb", "c" * 12]
    log = spark.createDataFrame([("f", i, v) for i, v in enumerate(["commit h1|An|5|fix | it", "", "M\ta.py", "R100\ta\tb", "commit h2|Bo|6|x", "A\tc"])], "file string, n int, value string")
    assert [(r.hash, r.status, r.path) for r in loaders.git_log(log).collect()] == [("h1", "M", "a.py"), ("h1", "R", "b"), ("h2", "A", "c")]


def test_inbox_batches_are_replaced_not_doubled(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", None, 1), ("2", "a", None, 2), ("3", "b", "c", 3)], inbox.ENTRY)
    for i in range(2):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        inbox.run_inbox(inbox.read_entries(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.id for r in inbox.stored(spark, str(tmp_path / "out")).collect()) == ["1", "3"]


def test_streamed_windows_and_ledger(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'x' as event_type, 2.0D as value union all select timestamp'2024-01-01 00:50:00', 'x', 3.0D").coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev"))
    query = inbox.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.n, r.total) for r in spark.table("windows").collect()] == [(2, 5.0)]
    spark.createDataFrame([("k", "Timeout"), ("k", "timeout"), ("k", "timeout"), ("j", "bad")], "batch_key string, error string").coalesce(1).write.parquet(str(tmp_path / "f"))
    failures = spark.readStream.schema("batch_key string, error string").parquet(str(tmp_path / "f"))
    query = inbox.attempt_ledger(failures).writeStream.format("memory").queryName("ledger").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    assert {r.batch_key: (r.attempts, r.state) for r in spark.table("ledger").collect()} == {"k": (3, "quarantine"), "j": (1, "quarantine")}


def test_nearest_of_many_by_blocks(spark, monkeypatch):
    """Each row's best against the plain expression, with ties, unlike lengths, zero vectors and rows of both tables; no join of all with all."""
    import random

    from memlake.functions import vector

    rnd = random.Random(2)
    some = lambda: rnd.choice([None, [0.0, 0.0, 0.0], [1.0, 2.0], [float(rnd.randrange(-2, 3)) for _ in range(3)], [rnd.gauss(0, 1) for _ in range(3)]])
    batch = spark.createDataFrame([(i, some()) for i in range(60)], "id bigint, embedding array<float>")
    corpus = spark.createDataFrame([(i, some()) for i in range(50, 250)], "id bigint, embedding array<float>").repartition(3)
    monkeypatch.setattr(ingest, "BATCH_ROWS", 25)
    near = ingest.nearest(batch, corpus)
    assert "NestedLoopJoin" not in near._jdf.queryExecution().executedPlan().toString()
    sims = corpus.where("embedding is not null").select(F.col("id").alias("other"), "embedding").join(batch.where("embedding is not null").select("id", F.col("embedding").alias("q")), F.col("other") != F.col("id"))
    best = sims.select("id", F.struct(F.round(vector.cosine(F.col("embedding"), F.col("q")), 6).alias("sim"), F.negate(F.xxhash64("other")).alias("tie"), "other").alias("m")).groupBy("id").agg(F.max("m").alias("m"))
    assert {r["id"]: (r["nearest"], r["sim"]) for r in near.collect()} == {r["id"]: (r["m"]["other"], r["m"]["sim"]) for r in best.collect()}
