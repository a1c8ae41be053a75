"""Vector, full-text, graph and hybrid retrieval over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake import projection as P
from memlake.functions import scoring, text, vector
from memlake.operators import filters, paths, retrieval, search
from memlake.queries import query

PROBE, PROBES = 7, (7, 42, 99)
TEXT, TAG = "the of and", "tag:source/src3"
KEYWORDS = ("edness", "thehe", "onor")
COS = "round(list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[])), 6)"
TOKENS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
TERMS = "['and', 'of', 'the']"


def probe(spark: SparkSession, sf_dir: str, vec_id: int = PROBE) -> list[float]:
    rows = P.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").limit(1).collect()
    return list(rows[0][0]) if rows else []


def corpus(spark: SparkSession, sf_dir: str) -> search.Corpus:
    return search.Corpus(P.memories(spark, sf_dir), P.tagged(spark, sf_dir), P.owned(spark, sf_dir), P.reinforces(spark, sf_dir).withColumn("edge_type", F.lit("reinforces")))


def vector_sql(where: str = "true", limit: int = 10) -> str:
    cos = COS.format("m.embedding", "q.embedding")
    return f"""SELECT m.id, {cos} AS vector FROM memory m, (SELECT embedding FROM embeddings WHERE vec_id = {PROBE}) q
        WHERE m.embedding IS NOT NULL AND {where} ORDER BY vector DESC, m.id LIMIT {limit}"""


def text_sql(limit: int = 10) -> str:
    return f"""SELECT id, round(hits / (hits + 10.0), 6) AS fulltext FROM (
        SELECT id, len(list_filter(toks, lambda w: list_contains({TERMS}, w))) AS hits
        FROM (SELECT id, {TOKENS.format('content')} AS toks FROM memory) WHERE list_has_all(toks, {TERMS}))
        ORDER BY fulltext DESC, id LIMIT {limit}"""


def tag_sql(limit: int = 10) -> str:
    return f"""SELECT id, 1.0::DOUBLE AS graph FROM memory WHERE id IN (SELECT in_id FROM tagged WHERE out_id = '{TAG}') ORDER BY id LIMIT {limit}"""


HYBRID = f"""{P.views('memory', 'tagged')}, v AS ({vector_sql()}), f AS ({text_sql()}), g AS ({tag_sql()}),
    c AS (SELECT id, vector, NULL::DOUBLE AS fulltext, NULL::DOUBLE AS graph FROM v UNION ALL SELECT id, NULL, fulltext, NULL FROM f
          UNION ALL SELECT id, NULL, NULL, graph FROM g),
    m AS (SELECT id, max(vector) AS vector, max(fulltext) AS fulltext, max(graph) AS graph FROM c GROUP BY id),
    s AS (SELECT id, round((coalesce(vector * 0.5, 0) + coalesce(fulltext * 0.3, 0) + coalesce(graph * 0.2, 0)) / (0.5 + 0.3 + 0.2), 6) AS score FROM m)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, vec = corpus(spark, sf_dir), probe(spark, sf_dir)
    found = [search.vector_search(c.memory, vec), search.fulltext_search(c.memory, TEXT)]
    graph = search.graph_search(c, search.SearchQuery(mode="graph", tags=(TAG,)))
    rows = None
    for mode, part in zip(("vector", "fulltext", "graph"), (*found, graph)):
        part = part.select("id", *[(F.col(m) if m == mode else F.lit(None)).cast("double").alias(m) for m in scoring.WEIGHTS])
        rows = part if rows is None else rows.unionByName(part)
    merged = rows.groupBy("id").agg(*[F.max(m).alias(m) for m in scoring.WEIGHTS])
    return merged.withColumn("score", F.round(scoring.merge_scores({m: F.col(m) for m in scoring.WEIGHTS}), 6))


@query(f"{HYBRID} SELECT id, score FROM s WHERE id IN (SELECT in_id FROM tagged WHERE out_id = '{TAG}') ORDER BY score DESC, id LIMIT 10")
def hybrid_search(spark, sf_dir):
    """The engine's own search in hybrid mode: tags are a modality and, as for any mode, a condition."""
    rows = search.search(corpus(spark, sf_dir), search.SearchQuery(vector=probe(spark, sf_dir), text=TEXT, tags=(TAG,)))
    return rows.select("id", "score")


@query(f"{HYBRID} SELECT id, score FROM s ORDER BY score DESC, id LIMIT 10")
def hybrid_union(spark, sf_dir):
    """The three modalities of the hybrid search without the tag as a condition."""
    return _hybrid(spark, sf_dir).select("id", "score").orderBy(F.col("score").desc(), "id").limit(10)


@query(f"{P.views('memory')} {vector_sql()}")
def vector_topk(spark, sf_dir):
    return search.vector_search(P.memories(spark, sf_dir), probe(spark, sf_dir))


_T1, _T2 = P.T0 + 20 * 3_600_000, P.T0 + 400 * 3_600_000


@query(f"{P.views('memory')} {vector_sql(f'm.event_time >= {_T1} AND m.event_time <= {_T2}')}")
def vector_topk_time_filtered(spark, sf_dir):
    return search.vector_search(P.memories(spark, sf_dir), probe(spark, sf_dir), after=_T1, before=_T2)


@query(f"{P.views('memory')} {text_sql()}")
def fulltext_all_terms(spark, sf_dir):
    return search.fulltext_search(P.memories(spark, sf_dir), TEXT)


@query(f"""{P.views('memory')} SELECT id, 0.3::DOUBLE AS fulltext FROM memory
    WHERE contains(lower(content), 'thethe') OR contains(lower(content), 'zzqq') OR contains(lower(content), 'onan') ORDER BY id LIMIT 10""")
def fulltext_fallback_ilike(spark, sf_dir):
    return search.fulltext_search(P.memories(spark, sf_dir), "thethe zzqq onan")


@query(f"{P.views('memory', 'tagged')} {tag_sql()}")
def tag_search_any_of(spark, sf_dir):
    return search.graph_search(corpus(spark, sf_dir), search.SearchQuery(mode="graph", tags=(TAG,)))


@query(f"""{P.views('tagged')} SELECT in_id AS id, string_agg(DISTINCT regexp_replace(out_id, '^tag:', ''), ',' ORDER BY regexp_replace(out_id, '^tag:', '')) AS tags
    FROM tagged GROUP BY in_id""")
def tag_hydration(spark, sf_dir):
    rows = P.memories(spark, sf_dir).select("id")
    return search.hydrate_tags(rows, P.tagged(spark, sf_dir)).select("id", F.array_join("tags", ",").alias("tags"))


@query(f"""{P.views('memory', 'owned')}, v AS ({vector_sql()}) SELECT id, vector AS score FROM v
    WHERE id IN (SELECT in_id FROM owned WHERE out_id = 'domain:kb') ORDER BY score DESC, id""")
def domain_scoped_search(spark, sf_dir):
    c = corpus(spark, sf_dir)
    rows = search.search(c, search.SearchQuery(mode="vector", vector=probe(spark, sf_dir), domains=("domain:kb",)))
    return rows.select("id", "score")


@query(f"""{HYBRID}, r AS (SELECT s.id, CASE WHEN m.embedding IS NULL THEN s.score
      ELSE {COS.format('m.embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 7)')} END AS score
      FROM s JOIN memory m ON m.id = s.id) SELECT id, score FROM r WHERE score >= 0.1 OR id IN (SELECT id FROM memory WHERE embedding IS NULL)""")
def rerank_by_embedding(spark, sf_dir):
    rows = _hybrid(spark, sf_dir).select("id", "score")
    return search.rerank_by_embedding(rows, P.memories(spark, sf_dir), probe(spark, sf_dir), 0.1)


@query(f"""{P.views('memory')}, t AS ({text_sql(50)}), u AS (SELECT t.id, fulltext AS score, token_count,
      CAST(sum(token_count) OVER (ORDER BY fulltext DESC, t.id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM t JOIN memory m ON m.id = t.id)
    SELECT id, score, token_count, used FROM u WHERE used <= 20000""")
def token_budget_prefix(spark, sf_dir):
    memory = P.memories(spark, sf_dir)
    rows = search.fulltext_search(memory, TEXT, 50).join(memory.select("id", "token_count"), "id").withColumnRenamed("fulltext", "score")
    return search.token_budget(rows, 20_000).select("id", "score", "token_count", "used")


@query(f"""{P.views('memory')}, t AS ({text_sql(50)}), o AS (SELECT t.id, fulltext AS score, token_count,
      row_number() OVER (ORDER BY fulltext DESC, t.id) AS n FROM t JOIN memory m ON m.id = t.id),
    g AS (SELECT n, id, score, token_count, token_count <= 20000 AS keep, CASE WHEN token_count <= 20000 THEN 20000 - token_count ELSE 20000 END AS room FROM o WHERE n = 1
      UNION ALL SELECT o.n, o.id, o.score, o.token_count, o.token_count <= g.room, CASE WHEN o.token_count <= g.room THEN g.room - o.token_count ELSE g.room END
      FROM o JOIN g ON o.n = g.n + 1)
    SELECT id, score, token_count FROM g WHERE keep""")
def token_budget_greedy(spark, sf_dir):
    memory = P.memories(spark, sf_dir)
    rows = search.fulltext_search(memory, TEXT, 50).join(memory.select("id", "token_count"), "id").withColumnRenamed("fulltext", "score")
    return retrieval.budget_skipping(rows.select("id", "score", "token_count"), 20_000)


_DEFAULTS = {"fact": 0.6, "decision": 0.9, "preference": 0.7, "event": 0.4}


@query(f"""{P.views('owned')} SELECT in_id AS id, round(CASE WHEN superseded THEN 0.8 * 0.05 ELSE 0.8 * (1 + (imp - 0.5) * 0.5) END, 6) AS score FROM (
    SELECT in_id, superseded, (CASE classification WHEN 'fact' THEN 0.6 WHEN 'decision' THEN 0.9 WHEN 'preference' THEN 0.7 WHEN 'event' THEN 0.4 ELSE 0.5 END)
      * pow(0.95, ({P.NOW} - owned_at) / 86400000.0 / 30.0) AS imp FROM owned WHERE out_id = 'domain:kb')""")
def domain_rank_importance(spark, sf_dir):
    rows = P.owned(spark, sf_dir).where("out_id = 'domain:kb'")
    weight = scoring.importance(F.lit(None).cast("double"), F.col("classification"), F.lit(P.NOW) - F.col("owned_at"), _DEFAULTS)
    return rows.select(F.col("in_id").alias("id"), F.round(scoring.domain_rank(F.lit(0.8), ~F.col("superseded"), weight), 6).alias("score"))


@query(f"""{P.views('memory', 'owned', 'tagged')} SELECT m.id FROM memory m WHERE m.id IN (SELECT in_id FROM owned
      WHERE out_id = 'domain:kb' AND classification = 'fact' AND owned_at >= {P.T0 + 600_000}) AND m.id IN (SELECT in_id FROM tagged WHERE out_id = 'tag:lang/en')""")
def get_memories_filtered(spark, sf_dir):
    owned = P.owned(spark, sf_dir).withColumn("attributes", F.to_json(F.struct("classification", "superseded")))
    rows = filters.get_memories(
        P.memories(spark, sf_dir), owned, ("domain:kb",), since=P.T0 + 600_000, attributes={"classification": "fact"},
        tagged=P.tagged(spark, sf_dir), tags=("tag:lang/en",),
    )
    return rows.select("id")


@query(f"{P.views('memory', 'owned')} SELECT id, created_at FROM memory WHERE id IN (SELECT in_id FROM owned WHERE out_id IN ('domain:kb', 'domain:chat'))")
def visible_memories(spark, sf_dir):
    return filters.owned_by(P.memories(spark, sf_dir), P.owned(spark, sf_dir), ("domain:kb", "domain:chat")).select("id", "created_at")


@query("""SELECT event_id FROM events WHERE list_has_any(CAST(list_value(event_type, CAST(user_id % 3 AS VARCHAR)) AS VARCHAR[]), ['purchase', '2'])""")
def json_contains_any(spark, sf_dir):
    listed = F.to_json(F.array(F.col("event_type"), (F.col("user_id") % 3).cast("string")))
    rows = P.table(spark, sf_dir, "events").withColumn("labels", listed)
    return rows.where(filters.field_filter("labels", {"containsAny": ["purchase", 2]})).select("event_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') = '42'")
def json_attr_equals(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return P.table(spark, sf_dir, "events").where(k == "42").select("event_id", k.cast("bigint").alias("k"))


@query(f"""{P.views('reinforces')}, b AS (SELECT in_id AS id, out_id AS far FROM reinforces UNION SELECT out_id, in_id FROM reinforces)
    SELECT id, string_agg(far, ',' ORDER BY far) AS refs FROM b GROUP BY id""")
def reference_connections(spark, sf_dir):
    edges = P.reinforces(spark, sf_dir).withColumn("edge_type", F.lit("reinforces"))
    rows = search.enrich_connections(P.memories(spark, sf_dir).select("id"), edges).where("references is not null")
    return rows.select("id", F.array_join(F.transform("references", lambda r: r["far"]), ",").alias("refs"))


@query(f"""{P.views('owned')} SELECT in_id AS id, string_agg(replace(out_id, 'domain:', '') || '=' || coalesce(classification, '-'), ';' ORDER BY out_id) AS domains
    FROM owned GROUP BY in_id""")
def domain_attributes(spark, sf_dir):
    owned = P.owned(spark, sf_dir).withColumn("attributes", F.coalesce("classification", F.lit("-")))
    rows = search.enrich_domains(P.memories(spark, sf_dir).select("id"), owned)
    return rows.select("id", F.array_join(F.transform(F.map_entries("domains"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("domains"))


@query(f"""{P.views('memory', 'owned')}, v AS ({vector_sql()}), o AS (SELECT DISTINCT in_id AS id FROM owned WHERE out_id = 'domain:kb'),
    k AS (SELECT m.id, CAST(contains(lower(content), 'edness') AS INT) + CAST(contains(lower(content), 'thehe') AS INT) + CAST(contains(lower(content), 'onor') AS INT) AS hits
      FROM memory m JOIN o ON o.id = m.id),
    a AS (SELECT v.id, CASE WHEN k.hits > 0 THEN vector * 1.3 ELSE vector END AS score FROM v LEFT JOIN k ON k.id = v.id
      UNION ALL SELECT id, hits / 3.0 FROM k WHERE hits > 0 AND id NOT IN (SELECT id FROM v))
    SELECT id, round(max(score), 6) AS score FROM a GROUP BY id""")
def keyword_merge(spark, sf_dir):
    memory, owned = P.memories(spark, sf_dir), P.owned(spark, sf_dir)
    rows = search.vector_search(memory, probe(spark, sf_dir)).withColumnRenamed("vector", "score")
    mine = filters.owned_by(memory, owned, ("domain:kb",))
    return retrieval.keyword_merge(rows, mine, KEYWORDS, per_keyword=None)


@query(f"""{P.views('memory')}, v AS ({vector_sql()}), q AS (SELECT item_id, text FROM benchmark),
    h AS (SELECT 'memory:' || item_id AS id, len(list_filter(toks, lambda w: list_contains(['the'], w))) AS n FROM (SELECT item_id, {TOKENS.format('text')} AS toks FROM q) WHERE list_has_all(toks, ['the'])),
    t AS (SELECT id, n / (n + 10.0) AS rank FROM h ORDER BY rank DESC, id LIMIT 20), x AS (SELECT max(rank) AS top FROM t),
    a AS (SELECT v.id, CASE WHEN t.rank IS NULL THEN vector ELSE vector * 1.5 END AS score FROM v LEFT JOIN t ON t.id = v.id
      UNION ALL SELECT id, 0.2 * rank / top FROM t, x WHERE id NOT IN (SELECT id FROM v))
    SELECT id, round(max(score), 6) AS score FROM a GROUP BY id""")
def question_merge(spark, sf_dir):
    asked = P.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("memory:"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("answers_question"))
    rows = search.vector_search(P.memories(spark, sf_dir), probe(spark, sf_dir)).withColumnRenamed("vector", "score")
    return retrieval.question_merge(rows, asked, "the")


@query(f"""{P.views('memory', 'owned')}, v AS ({vector_sql()}), top AS (SELECT DISTINCT 'topic:' || source AS id FROM documents WHERE contains(source, '1')),
    n AS (SELECT count(*) AS topics FROM top), m AS (SELECT 'memory:' || d.doc_id AS id, 1 AS matched FROM documents d JOIN top ON top.id = 'topic:' || d.source
      JOIN owned o ON o.in_id = 'memory:' || d.doc_id AND o.out_id = 'domain:kb'),
    a AS (SELECT v.id, CASE WHEN m.id IS NULL THEN vector ELSE vector * 1.3 END AS score FROM v LEFT JOIN m ON m.id = v.id
      UNION ALL SELECT m.id, 0.5 + 0.2 * least(1.0, matched / topics::DOUBLE) FROM m, n WHERE m.id NOT IN (SELECT id FROM v))
    SELECT id, round(max(score), 6) AS score FROM a GROUP BY id""")
def topic_graph_merge(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents").select("doc_id", "source")
    about = docs.select(F.concat(F.lit("memory:"), F.col("doc_id").cast("string")).alias("in_id"), F.concat(F.lit("topic:"), "source").alias("out_id"))
    topics = docs.where(F.col("source").contains("1")).select(F.concat(F.lit("topic:"), "source").alias("id")).distinct()
    mine = P.owned(spark, sf_dir).where("out_id = 'domain:kb'").select(F.col("in_id").alias("id")).distinct()
    rows = search.vector_search(P.memories(spark, sf_dir), probe(spark, sf_dir)).withColumnRenamed("vector", "score")
    return retrieval.topic_merge(rows, about, topics, mine)


@query(f"""{P.views('memory', 'reinforces', 'owned')}, s AS ({text_sql(200)}), ok AS (SELECT DISTINCT in_id AS id FROM owned WHERE out_id = 'domain:log'),
    r AS (SELECT coalesce(p.out_id, s.id) AS id, fulltext AS score FROM s LEFT JOIN (SELECT in_id, out_id FROM reinforces WHERE out_id IN (SELECT id FROM ok)) p ON p.in_id = s.id)
    SELECT id, round(max(score), 6) AS score FROM r GROUP BY id""")
def parent_resolution(spark, sf_dir):
    memory = P.memories(spark, sf_dir)
    rows = search.fulltext_search(memory, TEXT, 200).withColumnRenamed("fulltext", "score")
    valid = P.owned(spark, sf_dir).where("out_id = 'domain:log'").select(F.col("in_id").alias("id"))
    return retrieval.resolve_parents(rows, P.reinforces(spark, sf_dir), valid)


@query(f"""{P.views('memory')}, r AS (SELECT row_number() OVER (ORDER BY vector DESC, v.id) AS n, v.id, vector AS score, token_count AS size, embedding FROM ({vector_sql(limit=50)}) v JOIN memory m ON m.id = v.id),
    s AS (SELECT a.n, a.id, a.score, a.size, list({COS.format('a.embedding', 'b.embedding').replace('6)', '12)')} ORDER BY b.n) AS near FROM r a, r b GROUP BY a.n, a.id, a.score, a.size),
    g(step, chosen, room) AS (SELECT 0, []::BIGINT[], 10000 UNION ALL SELECT step + 1, list_append(chosen, -best.n), room - best.size FROM (
      SELECT step, chosen, room, max({{'value': round(0.7 * score - 0.3 * greatest(0, coalesce(list_max(list_transform(chosen, lambda i: near[i])), 0)), 9), 'n': -s.n, 'size': size}}) AS best
      FROM g JOIN s ON size <= room AND NOT list_contains(chosen, s.n) GROUP BY step, chosen, room))
    SELECT id, score, size AS token_count, list_position(chosen, n) - 1 AS place FROM s, (SELECT chosen FROM g ORDER BY step DESC LIMIT 1) WHERE list_contains(chosen, n)""")
def mmr_fill(spark, sf_dir):
    memory = P.memories(spark, sf_dir)
    rows = search.vector_search(memory, probe(spark, sf_dir), 50).withColumnRenamed("vector", "score")
    return retrieval.mmr_fill(rows.join(memory.select("id", "token_count", "embedding"), "id"), 10_000)


@query(f"""SELECT conv_id, turn, keep.layer, keep.used FROM (SELECT conv_id, turn, created_at, CAST(sum(token_count) OVER (PARTITION BY conv_id ORDER BY created_at, turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used
    FROM ({P.VIEWS['turn']})) t, LATERAL (SELECT 'working' AS layer, t.used AS used) keep WHERE t.used <= 400""")
def chat_context_budget(spark, sf_dir):
    from pyspark.sql import Window

    window = Window.partitionBy("conv_id").orderBy("created_at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = P.turns(spark, sf_dir).withColumn("used", F.sum("token_count").over(window)).where("used <= 400")
    return rows.select("conv_id", "turn", F.lit("working").alias("layer"), "used")


_LAYER = "CASE turn % 3 WHEN 0 THEN 'working' WHEN 1 THEN 'episodic' ELSE 'semantic' END"


@query(f"""SELECT conv_id, turn, layer, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, layer,
      CASE WHEN layer = 'working' THEN sum(token_count) OVER (PARTITION BY conv_id, layer ORDER BY created_at, turn)
      ELSE sum(token_count) OVER (PARTITION BY conv_id, layer ORDER BY created_at DESC, turn DESC) END AS used
      FROM (SELECT *, {_LAYER} AS layer FROM ({P.VIEWS['turn']})))
    WHERE used <= CASE layer WHEN 'working' THEN 200 WHEN 'episodic' THEN 120 ELSE 80 END""")
def chat_layer_budgets(spark, sf_dir):
    rows = P.turns(spark, sf_dir).withColumn("layer", F.expr(_LAYER))
    return retrieval.layered_budget(rows, 400, "conv_id", ("created_at", "turn")).select("conv_id", "turn", "layer", "used")


def _probe_sql(mode: str) -> str:
    cos = COS.format("c.embedding", "p.embedding")
    return f"""WITH p AS (SELECT vec_id AS probe, 1.0::DOUBLE AS weight, embedding FROM embeddings WHERE vec_id IN (7, 42, 99)),
      s AS (SELECT p.probe, p.weight, c.vec_id AS id, {cos} AS sim FROM embeddings c, p), mass AS (SELECT doc_id AS id, n_chars::DOUBLE AS mass FROM documents), mx AS (SELECT max(mass) AS most FROM mass) {mode}"""


def _scored(spark, sf_dir) -> DataFrame:
    vectors = P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    probes = vectors.where(F.col("id").isin(*PROBES)).select(F.col("id").alias("probe"), F.lit(1.0).alias("weight"), "embedding")
    return paths.probe_scores(vectors, probes)


def _mass(spark, sf_dir) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("mass"))


_TOP = "row_number() OVER (PARTITION BY probe ORDER BY sim DESC, id) AS place"


@query(_probe_sql(f"SELECT probe, id, sim FROM (SELECT *, {_TOP} FROM s) WHERE place <= 5"))
def anchor_cosine(spark, sf_dir):
    return paths.per_probe_top(_scored(spark, sf_dir)).select("probe", "id", "sim")


@query(_probe_sql(f""", b AS (SELECT s.probe, s.id, round(s.sim * (1 + 0.8 * coalesce(m.mass / mx.most, 0)), 6) AS sim FROM s LEFT JOIN mass m ON m.id = s.id, mx)
    SELECT probe, id, sim FROM (SELECT *, {_TOP} FROM b) WHERE place <= 5"""))
def anchor_idf_mass(spark, sf_dir):
    return paths.idf_mass_anchor(_scored(spark, sf_dir), _mass(spark, sf_dir), 0.8).select("probe", "id", "sim")


_DENSITY = "d AS (SELECT id, sum(weight * greatest(sim - 0.2, 0)) AS mass, count(*) FILTER (sim - 0.2 > 0) AS n FROM s GROUP BY id)"


@query(_probe_sql(f", {_DENSITY} SELECT id, round(mass, 6) AS score FROM d WHERE mass > 0 ORDER BY score DESC, id LIMIT 5"))
def anchor_density(spark, sf_dir):
    return paths.density(_scored(spark, sf_dir))


@query(_probe_sql(f", {_DENSITY} SELECT id, round(mass, 6) AS score FROM d WHERE mass > 0 ORDER BY score DESC, id LIMIT 20"))
def compose_fusion(spark, sf_dir):
    return paths.compose_fusion(_scored(spark, sf_dir), top=20)


@query(_probe_sql(f", {_DENSITY} SELECT id, round(mass * pow(1.5, n - 1), 6) AS score FROM d WHERE mass > 0 ORDER BY score DESC, id LIMIT 5"))
def anchor_coverage(spark, sf_dir):
    return paths.density(_scored(spark, sf_dir), exponent=1.5)


@query(_probe_sql(""" SELECT id, round(min(sim) + 1e-6 * sum(sim), 6) AS score FROM s GROUP BY id HAVING count(*) FILTER (sim > 0.0) = 3 ORDER BY score DESC, id LIMIT 5"""))
def anchor_min_gate(spark, sf_dir):
    return paths.min_gate(_scored(spark, sf_dir), tau=0.0)


@query(_probe_sql(f""", {_DENSITY} SELECT d.id, round(round(d.mass, 6) * (1 + 0.5 * coalesce(m.mass / mx.most, 0)), 6) AS score FROM d LEFT JOIN mass m ON m.id = d.id, mx
    WHERE d.mass > 0 ORDER BY score DESC, d.id LIMIT 5"""))
def anchor_idf_fusion(spark, sf_dir):
    return paths.idf_fusion(_scored(spark, sf_dir), _mass(spark, sf_dir), 0.5)


@query(_probe_sql(f"""SELECT id, round(sum(1.0 / (60 + place)), 6) AS score FROM (SELECT *, {_TOP} FROM s) WHERE place <= 50 GROUP BY id ORDER BY score DESC, id LIMIT 5"""))
def anchor_rrf(spark, sf_dir):
    return paths.reciprocal_rank(_scored(spark, sf_dir))


@query(_probe_sql(f"""SELECT id, string_agg(CAST(probe AS VARCHAR), ',' ORDER BY probe) AS probes FROM (SELECT *, {_TOP} FROM s) WHERE place <= 20 GROUP BY id"""))
def compose_union(spark, sf_dir):
    rows = paths.compose_union(paths.per_probe_top(_scored(spark, sf_dir), 20))
    return rows.select("id", F.array_join(F.col("probes").cast("array<string>"), ",").alias("probes"))


@query(_probe_sql(f""", t AS (SELECT *, {_TOP} FROM s), u AS (SELECT id, string_agg(CAST(probe AS VARCHAR), ',' ORDER BY probe) AS probes, count(*) AS n FROM t WHERE place <= 20 GROUP BY id)
    SELECT id, probes FROM u WHERE n >= 1.5 OR NOT EXISTS (SELECT 1 FROM u WHERE n >= 1.5)"""))
def compose_intersection(spark, sf_dir):
    rows = paths.compose_intersection(paths.per_probe_top(_scored(spark, sf_dir), 20))
    return rows.select("id", F.array_join(F.col("probes").cast("array<string>"), ",").alias("probes"))


@query(f"""SELECT conv_id, turn, round(exp(-(max(turn) OVER (PARTITION BY conv_id) - turn) / 3.0), 6) AS weight FROM conversations""")
def session_decay(spark, sf_dir):
    rows = P.turns(spark, sf_dir).select(F.col("conv_id").alias("session"), "turn")
    return paths.session_weights(rows, 3.0).select(F.col("session").alias("conv_id"), "turn", F.round("weight", 6).alias("weight"))


@query(f"""SELECT doc_id, {COS.format('e.embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 42)')} AS cosine
    FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""")
def cosine_join(spark, sf_dir):
    rows = P.table(spark, sf_dir, "documents").select("doc_id").join(P.table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return rows.select("doc_id", F.round(vector.cosine(F.col("embedding"), vector.literal(probe(spark, sf_dir, 42))), 6).alias("cosine"))


@query("""SELECT doc_id, CAST(len(list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: length(w) > 2))) AS BIGINT) AS n_words FROM documents""")
def word_sets(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", F.size(text.word_set(F.col("text"))).cast("bigint").alias("n_words"))
