"""Contexts of domains, inbox phases, and the smaller views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake import projection as P
from memlake.operators import contexts, enrich, evaluate, filters, ingest, jobs, phases, search, sequence
from memlake.plans.scratch import cut
from memlake.queries import query
from memlake.queries.search_queries import COS, KEYWORDS, TEXT, corpus, probe, text_sql, vector_sql

WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: length(w) > 2))"
SECTIONS = {"Facts & References": ("fact", "event"), "Decisions": ("decision", "preference"), "Recent Observations": ("observation",)}
BUDGET = 20_000


def greedy_sql(source: str, threshold: float = 0.5) -> str:
    """CTEs ``o`` and ``g``: rows (id, score) of ``source`` in order, each the alias of the first kept one whose words are close."""
    return f"""o AS (SELECT row_number() OVER (ORDER BY score DESC, x.id) AS n, x.id, score, {WORDS.format('content')} AS words FROM {source} x JOIN memory m ON m.id = x.id),
    g(n, id, score, alias_of, ids, sets) AS (SELECT n, id, score, id, [id], [words] FROM o WHERE n = 1
      UNION ALL SELECT z.n, z.id, z.score, coalesce(z.ids[z.hit], z.id), CASE WHEN z.hit IS NULL THEN list_append(z.ids, z.id) ELSE z.ids END, CASE WHEN z.hit IS NULL THEN list_append(z.sets, z.words) ELSE z.sets END
      FROM (SELECT o.n, o.id, o.score, o.words, g.ids, g.sets, list_filter(range(1, len(g.sets) + 1), lambda i: CASE WHEN len(list_concat(g.sets[i], o.words)) = 0 THEN true
        ELSE len(list_intersect(g.sets[i], o.words)) >= {threshold} * len(list_distinct(list_concat(g.sets[i], o.words))) END)[1] AS hit FROM o JOIN g ON o.n = g.n + 1) z)"""


@query(f"""{P.views('memory')}, t AS (SELECT id, fulltext AS score FROM ({text_sql(100)})), {greedy_sql('t')} SELECT id, score, alias_of FROM g""")
def dedup_greedy(spark, sf_dir):
    from memlake.operators import retrieval

    memory = P.memories(spark, sf_dir)
    rows = search.fulltext_search(memory, TEXT, 100).withColumnRenamed("fulltext", "score")
    return retrieval.dedupe_greedy(rows, memory)


_FOUND = f"""v AS ({vector_sql(limit=50)}), f AS ({text_sql(50)}),
    s AS (SELECT id, round((coalesce(max(vector) * 0.5, 0) + coalesce(max(fulltext) * 0.3, 0)) / (0.5 + 0.3 + 0.2), 6) AS score
      FROM (SELECT id, vector, NULL::DOUBLE AS fulltext FROM v UNION ALL SELECT id, NULL, fulltext FROM f) GROUP BY id)"""


@query(f"""{P.views('memory')}, {_FOUND}, r AS (SELECT s.id, score, content, row_number() OVER w AS n, sum(token_count) OVER (w ROWS UNBOUNDED PRECEDING) AS used
      FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 50) s JOIN memory m ON m.id = s.id WINDOW w AS (ORDER BY score DESC, s.id))
    SELECT coalesce(string_agg('[' || n || '] ' || content, chr(10) ORDER BY n), '') AS context FROM r WHERE used <= 4000""")
def build_context(spark, sf_dir):
    c = corpus(spark, sf_dir)
    rows = search.search(c, search.SearchQuery(vector=probe(spark, sf_dir), text=TEXT, limit=50))
    return search.build_context(rows, c.memory)


_KEYS = " UNION ALL ".join(f"(SELECT id, '{w}' AS word FROM k WHERE contains(lower(content), '{w}') ORDER BY id LIMIT 20)" for w in KEYWORDS)


@query(f"""{P.views('memory', 'owned', 'reinforces')}, {_FOUND}, mine AS (SELECT in_id AS id, classification FROM owned WHERE out_id = 'domain:kb' AND NOT superseded),
    r AS (SELECT s.id, CASE WHEN m.embedding IS NULL THEN s.score ELSE {COS.format('m.embedding', f'(SELECT embedding FROM embeddings WHERE vec_id = 7)')} END AS score, token_count
      FROM s JOIN memory m ON m.id = s.id WHERE s.id IN (SELECT in_id FROM owned WHERE out_id = 'domain:kb')),
    t AS (SELECT * FROM r WHERE score >= 0 ORDER BY score DESC, id LIMIT 50),
    b AS (SELECT id, score FROM (SELECT *, sum(token_count) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM t) WHERE used <= {3 * BUDGET} AND id IN (SELECT id FROM mine)),
    k AS (SELECT id, content FROM memory WHERE id IN (SELECT id FROM mine)), kh AS (SELECT id, count(DISTINCT word) AS hits FROM ({_KEYS}) GROUP BY id),
    b1 AS (SELECT id, round(max(score), 6) AS score FROM (SELECT b.id, CASE WHEN hits IS NULL THEN score ELSE score * 1.3 END AS score FROM b LEFT JOIN kh ON kh.id = b.id
      UNION ALL SELECT id, hits / 3.0 FROM kh WHERE id NOT IN (SELECT id FROM b)) GROUP BY id),
    tm AS (SELECT m.id, 1 AS matched FROM memory m WHERE contains(source, '1') AND id IN (SELECT id FROM mine) ORDER BY matched DESC, m.id LIMIT 50),
    tn AS (SELECT count(DISTINCT source) AS n FROM documents WHERE contains(source, '1')),
    b2 AS (SELECT id, round(max(score), 6) AS score FROM (SELECT b1.id, CASE WHEN matched IS NULL THEN score ELSE score * 1.3 END AS score FROM b1 LEFT JOIN tm ON tm.id = b1.id
      UNION ALL SELECT id, 0.5 + 0.2 * least(1.0, matched / n::DOUBLE) FROM tm, tn WHERE id NOT IN (SELECT id FROM b1)) GROUP BY id),
    b3 AS (SELECT id, round(max(score), 6) AS score FROM (SELECT coalesce(p.out_id, b2.id) AS id, score FROM b2 LEFT JOIN (SELECT in_id, out_id FROM reinforces WHERE out_id IN (SELECT id FROM mine)) p ON p.in_id = b2.id) GROUP BY id),
    {greedy_sql('b3')},
    q AS (SELECT row_number() OVER (ORDER BY score DESC, g.id) AS i, g.id, m.token_count AS size FROM g JOIN memory m ON m.id = g.id WHERE alias_of = g.id),
    h(i, id, keep, room) AS (SELECT i, id, size <= {BUDGET}, CASE WHEN size <= {BUDGET} THEN {BUDGET} - size ELSE {BUDGET} END FROM q WHERE i = 1
      UNION ALL SELECT q.i, q.id, size <= room, CASE WHEN size <= room THEN room - size ELSE room END FROM q JOIN h ON q.i = h.i + 1)
    SELECT g.id, g.alias_of, g.score, CASE WHEN classification IN ('fact', 'event') THEN 'Facts & References' WHEN classification IN ('decision', 'preference') THEN 'Decisions' ELSE 'Recent Observations' END AS section
    FROM g JOIN h ON h.id = g.alias_of JOIN mine ON mine.id = g.alias_of WHERE keep AND classification <> 'other' AND EXISTS (SELECT 1 FROM b)""")
def domain_context_entries(spark, sf_dir):
    """A domain's whole context pipeline: what it shows for a query, near copies with their survivors."""
    c = corpus(spark, sf_dir)
    owned = P.owned(spark, sf_dir).withColumn("attributes", F.to_json(F.struct("classification", "superseded")))
    docs = P.table(spark, sf_dir, "documents").select("doc_id", "source")
    about = docs.select(F.concat(F.lit("memory:"), F.col("doc_id").cast("string")).alias("in_id"), F.concat(F.lit("topic:"), "source").alias("out_id"))
    topics = docs.where(F.col("source").contains("1")).select(F.concat(F.lit("topic:"), "source").alias("id")).distinct()
    plan = contexts.Plan(sections=SECTIONS, keywords=KEYWORDS, topics=topics, about=about, refines=P.reinforces(spark, sf_dir))
    asked = search.SearchQuery(vector=probe(spark, sf_dir), text=TEXT, limit=50, domains=("domain:kb",))
    rows = contexts.domain_entries(search.Corpus(c.memory, c.tagged, owned, c.references), asked, "kb", plan, P.NOW, BUDGET)
    return rows.select("id", "alias_of", "score", "section")


_LAYER = "CASE turn % 3 WHEN 0 THEN 'working' WHEN 1 THEN 'episodic' ELSE 'semantic' END"


@query(f"""WITH t AS (SELECT conv_id, turn, text, {_LAYER} AS layer, created_at, token_count FROM ({P.VIEWS['turn']})),
    u AS (SELECT *, CASE WHEN layer = 'working' THEN turn ELSE -turn END AS place, sum(token_count) OVER (PARTITION BY conv_id, layer ORDER BY CASE WHEN layer = 'working' THEN turn ELSE -turn END) AS used FROM t),
    k AS (SELECT * FROM u WHERE used <= CASE layer WHEN 'working' THEN 200 WHEN 'episodic' THEN 120 ELSE 80 END),
    s AS (SELECT conv_id, layer, '[' || CASE layer WHEN 'working' THEN 'Recent' WHEN 'episodic' THEN 'Context' ELSE 'Background' END || ']' || chr(10) || string_agg(text, chr(10) ORDER BY place) AS body FROM k GROUP BY conv_id, layer)
    SELECT conv_id, md5(string_agg(body, chr(10) || chr(10) ORDER BY CASE layer WHEN 'working' THEN 0 WHEN 'episodic' THEN 1 ELSE 2 END)) AS digest FROM s GROUP BY conv_id""")
def chat_context(spark, sf_dir):
    """The three layers of each conversation as one text."""
    rows = P.turns(spark, sf_dir).withColumn("layer", F.expr(_LAYER)).withColumnRenamed("text", "content")
    return contexts.chat_context(rows, 400, "conv_id", ("created_at", "turn")).select("conv_id", F.md5("context").alias("digest"))


@query("""WITH n AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE contains(lower(n_name), 'a') ORDER BY id LIMIT 5), r AS (SELECT 'region:' || r_regionkey AS id FROM region WHERE contains(lower(r_name), 'a') ORDER BY id LIMIT 5),
    a AS (SELECT 'memory:' || c_custkey AS in_id, 'nation:' || c_nationkey AS out_id FROM customer)
    SELECT DISTINCT in_id AS id FROM a WHERE out_id IN (SELECT id FROM n UNION SELECT id FROM r)""")
def expand_by_entities(spark, sf_dir):
    """Entities that the query text names, then the memories about them."""
    named = lambda t, p: P.table(spark, sf_dir, t).select(F.concat(F.lit(f"{t}:"), F.col(f"{p}_{t}key").cast("string")).alias("id"), F.col(f"{p}_name").alias("name"))
    expand = contexts.entity_expansion({"nation": named("nation", "n"), "region": named("region", "r")})
    asked = expand(search.SearchQuery(text="a"))
    about = P.table(spark, sf_dir, "customer").select(F.concat(F.lit("memory:"), F.col("c_custkey").cast("string")).alias("in_id"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("out_id"))
    return search.hop({"about_entity": about}, asked.start, asked.traversal)


@query(f"""{P.views('memory', 'tagged', 'reinforces')} SELECT DISTINCT in_id AS id FROM reinforces WHERE out_id IN (SELECT id FROM memory
    WHERE id IN (SELECT in_id FROM tagged WHERE out_id = 'tag:lang/en') AND (contains(lower(content), 'what') OR contains(lower(content), 'onal')))""")
def expand_by_topics(spark, sf_dir):
    """Topic entries that hold a query word, then what is about them."""
    asked = contexts.topic_expansion(P.memories(spark, sf_dir), P.tagged(spark, sf_dir), "about_topic", "tag:lang/en")(search.SearchQuery(text="what onal is"))
    edges = P.reinforces(spark, sf_dir)
    return search.hop({"about_topic": edges}, asked.start, asked.traversal) if asked.traversal else edges.where("false").select(F.col("in_id").alias("id"))


@query(f"""{P.views('memory')}, t AS (SELECT id, fulltext AS score, CAST(right(id, 1) AS INT) % 6 AS grade FROM ({text_sql(50)}))
    SELECT id, CASE WHEN (SELECT max(grade) FROM t) >= 3 THEN round(grade / 5.0, 6) ELSE score END AS score FROM t WHERE grade >= 3 OR (SELECT max(grade) FROM t) < 3""")
def rerank_by_grades(spark, sf_dir):
    """Grades of a stand-in judge, from the last digit of the id."""
    from memlake.operators import retrieval

    rows = search.fulltext_search(P.memories(spark, sf_dir), TEXT, 50).withColumnRenamed("fulltext", "score")
    return retrieval.rerank_by_model(rows, lambda r: r.select("id", (F.right("id", F.lit(1)).cast("int") % 6).alias("grade")))


# -- inbox -----------------------------------------------------------------------------------------
_DOMAINS = [("log", "write", True, False), ("kb", "write", False, True), ("chat", "write", False, True), ("faq", "write", False, True), ("old", "read", True, True)]


def _inbox(spark, sf_dir):
    """Documents addressed to nobody (every ninth to the log by name), and the tags after the claims."""
    memory = cut(P.memories(spark, sf_dir).select("id", "doc_id", "lang", "source", "created_at", "embedding"), "inbox")
    targets = F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("log"), F.lit("old"))).otherwise(F.array().cast("array<string>"))
    owners, tags = phases.address(memory.select("id", targets.alias("targets")), spark.createDataFrame(_DOMAINS, "domain string, access string, auto_own boolean, claims boolean"))
    wants = {"kb": "lang = 'en'", "chat": "source = 'src1'", "faq": "source = 'src2'"}
    hooks = {domain: phases.Whole(lambda r, test=test: r.where(test).select("id")) for domain, test in wants.items()}
    return memory, owners, phases.claim_phase(memory, tags, hooks, batches=None)


_CLAIMED = """d AS (SELECT 'memory:' || doc_id AS id, doc_id % 9 = 0 AS named, lang, source FROM documents),
    claimed AS (SELECT id, 'kb' AS domain FROM d WHERE NOT named AND lang = 'en' UNION ALL SELECT id, 'chat' FROM d WHERE NOT named AND source = 'src1' UNION ALL SELECT id, 'faq' FROM d WHERE NOT named AND source = 'src2'),
    owned_ AS (SELECT id, 'log' AS domain FROM d UNION ALL SELECT id, domain FROM claimed)"""


@query(f"""WITH {_CLAIMED} SELECT id AS in_id, 'domain:' || domain AS out_id FROM owned_ UNION ALL SELECT id, 'tag:inbox:' || domain FROM owned_ UNION ALL SELECT id, 'tag:inbox' FROM d""")
def inbox_address_claim(spark, sf_dir):
    """Owner and tag edges once entries have been addressed and claimed."""
    _, owners, claimed = _inbox(spark, sf_dir)
    return owners.unionByName(claimed.owners).unionByName(claimed.tags)


def _batches_sql(source: str, threshold: float, size: int = 50, stretch: int = 1000) -> str:
    """(id, context_key, stretch, batch, place) as ``dealt``: batch after batch out of what is left of ``source``
    (id, created_at, embedding, context_key)."""
    sim = f"CASE WHEN embedding IS NOT NULL AND seed IS NOT NULL THEN {COS.format('embedding', 'seed')} END"
    return f"""aged AS (SELECT *, (row_number() OVER (PARTITION BY context_key ORDER BY created_at, id) - 1) // {stretch} AS stretch FROM ({source})),
    left_(id, created_at, embedding, context_key, stretch, batch, place) AS (SELECT id, created_at, embedding, context_key, stretch, -1, CAST(NULL AS BIGINT) FROM aged
      UNION ALL SELECT id, created_at, embedding, context_key, stretch, batch + 1, CASE WHEN fits AND nth <= {size} THEN nth - 1 END FROM (
        SELECT *, row_number() OVER (PARTITION BY context_key, stretch ORDER BY NOT fits, age > 1, CASE WHEN seed IS NULL THEN 0 ELSE sim END DESC NULLS LAST, age) AS nth FROM (
          SELECT *, age = 1 OR sim IS NULL OR {f"sim >= {threshold}" if threshold > 0 else "true"} AS fits FROM (
            SELECT *, {sim} AS sim FROM (
              SELECT *, first_value(embedding) OVER (PARTITION BY context_key, stretch ORDER BY created_at, id) AS seed,
                row_number() OVER (PARTITION BY context_key, stretch ORDER BY created_at, id) AS age FROM left_ WHERE place IS NULL))))),
    dealt AS (SELECT id, context_key, stretch, batch, CAST(place AS INTEGER) AS place FROM left_ WHERE place IS NOT NULL)"""


@query(f"""{P.views('memory')}, {_batches_sql("SELECT id, created_at, embedding, coalesce(source, '') AS context_key FROM memory", 0.1)} SELECT * FROM dealt""")
def inbox_batches(spark, sf_dir):
    """The whole queue in batches, with a document's source as the context of its request."""
    return ingest.assign_batches(P.memories(spark, sf_dir).withColumn("request_context", F.col("source")), 0.1)


@query(f"""{P.views('memory')}, {_CLAIMED},
    {_batches_sql("SELECT m.id, created_at, embedding, '' AS context_key FROM memory m JOIN claimed c ON c.id = m.id AND c.domain = 'faq'", 0.0)},
    bad AS (SELECT DISTINCT stretch, batch FROM dealt WHERE CAST(substr(id, 8) AS BIGINT) % 97 = 5)
    SELECT id AS in_id, 'tag:inbox:failed:faq' AS out_id FROM dealt SEMI JOIN bad ON bad.stretch = dealt.stretch AND bad.batch = dealt.batch
    UNION ALL SELECT id, 'tag:inbox:chat' FROM claimed WHERE domain = 'chat' UNION ALL SELECT id, 'tag:inbox' FROM claimed WHERE domain = 'chat'""")
def inbox_process_phase(spark, sf_dir):
    """Tags after processing: a handler fails for batches that hold a bad entry, another domain has none yet."""
    bad = lambda r: r.where("doc_id % 97 = 5").select("batch_key", F.lit("ValueError").alias("name"), F.lit("bad input").alias("error"))
    memory, _, claimed = _inbox(spark, sf_dir)
    hooks = {"log": phases.Whole(lambda r: r), "kb": phases.Whole(lambda r: None), "faq": phases.Whole(lambda r: None, bad)}
    return phases.process_phase(memory, claimed.tags, hooks, batches=None).tags


# -- maintenance and enrichment --------------------------------------------------------------------
_ABOUT = """a AS (SELECT 'memory:' || doc_id AS id, doc_id, 'user:' || (doc_id // 16) AS who FROM documents WHERE doc_id % 3 > 0)"""


def _about(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents").where("doc_id % 3 > 0")
    return docs.select(F.concat(F.lit("memory:"), F.col("doc_id").cast("string")).alias("in_id"), F.concat(F.lit("user:"), F.expr("doc_id div 16").cast("string")).alias("out_id"))


def _attributed(spark, sf_dir):
    return P.owned(spark, sf_dir).withColumn("attributes", F.to_json(F.struct("classification", "superseded")))


@query(f"""{P.views('memory', 'owned')}, {_ABOUT} SELECT who AS "user", count(*) AS n, md5(string_agg(content, chr(10) ORDER BY created_at, m.id)) AS digest FROM a JOIN memory m ON m.id = a.id
    WHERE a.id NOT IN (SELECT in_id FROM owned WHERE out_id = 'domain:kb' AND superseded) GROUP BY who""")
def profile_sources(spark, sf_dir):
    rows = jobs.profile_sources(_about(spark, sf_dir), P.memories(spark, sf_dir), _attributed(spark, sf_dir), "kb", P.NOW)
    return rows.select("user", F.size("contents").cast("bigint").alias("n"), F.md5(F.array_join("contents", "\n")).alias("digest"))


_ROOM = 45_000


@query(f"""{P.views('memory', 'owned')}, {_ABOUT}, n AS (SELECT 'memory:' || doc_id AS id, CAST(doc_id // 16 AS VARCHAR) AS who, text FROM documents WHERE doc_id % 17 = 0),
    o AS (SELECT a.id, replace(who, 'user:', '') AS who, content FROM a JOIN memory m ON m.id = a.id WHERE a.id NOT IN (SELECT id FROM n) AND a.id NOT IN (SELECT in_id FROM owned WHERE out_id = 'domain:kb' AND superseded) AND length(content) > 0),
    z AS (SELECT who FROM (SELECT who, text FROM n UNION ALL SELECT who, content FROM o) GROUP BY who HAVING sum(length(text)) <= {_ROOM})
    SELECT n.who AS "user", n.id AS new, o.id AS old FROM n JOIN o ON o.who = n.who WHERE n.who IN (SELECT who FROM z)""")
def user_fact_pairs(spark, sf_dir):
    """What a judge of supersession sees of each user; users with too much text are left to another run."""
    memory = P.memories(spark, sf_dir)
    fresh = memory.where("doc_id % 17 = 0").select("id", F.expr("doc_id div 16").cast("string").alias("user"), "content")
    return enrich.user_facts(fresh, _about(spark, sf_dir), memory, _attributed(spark, sf_dir), "kb", _ROOM)


_FILES = """f AS (SELECT doc_id AS place, CASE WHEN source IN ('src1', 'src2') AND doc_id % 2 = 0 THEN 'D' ELSE 'A' END AS status,
    CASE WHEN doc_id % 10 = 0 THEN 'top' ELSE source || '/' || lang || '-lib' END AS folder, CASE WHEN doc_id % 50 = 1 THEN 'UserRole.x' ELSE 'f' || doc_id END AS name FROM documents)"""


def _scan(spark, sf_dir):
    folder = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat("source", F.lit("/"), "lang", F.lit("-lib/")))
    name = F.when(F.col("doc_id") % 50 == 1, "UserRole.x").otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    status = F.when(F.col("source").isin("src1", "src2") & (F.col("doc_id") % 2 == 0), "D").otherwise("A")
    return jobs.scan_commits(P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), status.alias("status"), F.concat(folder, name).alias("path")))


@query(f"""WITH {_FILES} SELECT folder AS path, regexp_replace(folder, '.*/', '') AS name, 'library' AS kind, CASE WHEN count(*) FILTER (status = 'D') = 0 THEN 'active' ELSE 'archived' END AS status
    FROM f WHERE folder <> 'top' GROUP BY folder""")
def commit_modules(spark, sf_dir):
    return _scan(spark, sf_dir)[0]


@query(f"""WITH {_FILES}, g AS (SELECT folder AS path, min(place) AS place, CASE WHEN count(*) FILTER (status = 'D') = 0 THEN 'new folders' ELSE 'removed folders' END AS topic FROM f WHERE folder <> 'top' GROUP BY folder
      UNION ALL SELECT CASE folder WHEN 'top' THEN name ELSE folder || '/' || name END, place, 'business' FROM f WHERE status = 'A' AND contains(lower(name), 'role')),
    h AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY place, path) AS i FROM g)
    SELECT topic, count(*) AS n, string_agg(path, ', ' ORDER BY place, path) FILTER (i <= CASE topic WHEN 'business' THEN 5 ELSE 10 END) AS listing FROM h GROUP BY topic""")
def commit_notes(spark, sf_dir):
    return _scan(spark, sf_dir)[1]


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN '' WHEN doc_id % 5 = 3 THEN 'again ' || doc_id ELSE 'first ' || doc_id END AS answers_question FROM documents""")
def asked_questions(spark, sf_dir):
    """A stand-in model that leaves some rows out when it is asked about all, and some always."""
    rows = P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    calls = []

    def ask(some):
        calls.append(1)
        word, test = ("first ", "id % 5 < 3") if len(calls) == 1 else ("again ", "id % 5 = 3")
        return some.where(test).select("id", F.concat(F.lit(word), F.col("id").cast("string")).alias("question"))

    return enrich.ask_questions(rows, ask).withColumnRenamed("id", "doc_id")


# -- views -----------------------------------------------------------------------------------------
@query(f"""{P.views('memory')} SELECT id, content, event_time AS "eventTime", created_at AS "createdAt", token_count AS "tokenCount" FROM memory""")
def entry_fields(spark, sf_dir):
    return search.entry_fields(P.memories(spark, sf_dir))


@query(f"""{P.views('tagged')} SELECT in_id AS "in", out_id AS "out" FROM tagged""")
def edge_ends(spark, sf_dir):
    return search.edge_ends(P.tagged(spark, sf_dir))


@query(f"""{P.views('owned')} SELECT in_id, out_id FROM owned WHERE superseded IS DISTINCT FROM true""")
def null_safe_filter(spark, sf_dir):
    return P.owned(spark, sf_dir).where(filters.differs(F.col("superseded"), True)).select("in_id", "out_id")


@query(f"""{P.views('memory', 'owned')} SELECT id, (SELECT out_id FROM owned o WHERE o.in_id = m.id ORDER BY owned_at, out_id LIMIT 1) AS owner FROM memory m""")
def first_owner(spark, sf_dir):
    return search.first_owner(P.memories(spark, sf_dir).select("id"), _attributed(spark, sf_dir)).select("id", "owner")


@query("SELECT user_id, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 GROUP BY user_id")
def first_seen(spark, sf_dir):
    return sequence.first_seen(P.table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("""WITH t AS (SELECT conv_id % 5 AS stream, conv_id AS session, turn, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id, turn) - 1 AS step FROM conversations),
    s AS (SELECT stream, session, min(step) AS start, count(*) AS n FROM t GROUP BY stream, session)
    SELECT stream, CAST(sum(n) AS BIGINT) AS n, count(*) AS sessions, string_agg(CAST(start AS VARCHAR), ',' ORDER BY start) FILTER (start > 0) AS gold FROM s GROUP BY stream""")
def eval_flat_sessions(spark, sf_dir):
    turns = P.table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("stream"), F.col("conv_id").alias("session"), "turn")
    return sequence.flatten_sessions(turns).withColumn("gold", F.array_join(F.col("gold").cast("array<string>"), ","))


_RANKED = """r AS (SELECT source AS query, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"""


def _ranked(spark, sf_dir):
    order = Window.partitionBy("query").orderBy(F.col("n_chars").desc(), "id")
    return P.table(spark, sf_dir, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("id"), "n_chars").withColumn("rank", F.row_number().over(order)).drop("n_chars")


@query(f"""WITH {_RANKED}, p AS (SELECT source AS query, min(doc_id) AS target, max(doc_id) AS distractor FROM documents GROUP BY source)
    SELECT round(avg(CAST(coalesce(t.rank < d.rank, d.rank IS NULL AND t.rank IS NOT NULL) AS INT)), 6) AS pair_accuracy, count(*) AS queries FROM p
    LEFT JOIN (SELECT * FROM r WHERE rank <= 20) t ON t.query = p.query AND t.id = p.target LEFT JOIN (SELECT * FROM r WHERE rank <= 20) d ON d.query = p.query AND d.id = p.distractor""")
def eval_pair_accuracy(spark, sf_dir):
    pairs = P.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("query")).agg(F.min("doc_id").alias("target"), F.max("doc_id").alias("distractor"))
    return evaluate.pair_accuracy(_ranked(spark, sf_dir).where("rank <= 20"), pairs)


@query(f"""WITH {_RANKED}, s AS (SELECT query, id FROM r WHERE rank <= 5), g AS (SELECT source AS query, doc_id AS id FROM documents WHERE doc_id % 7 = 0),
    c AS (SELECT g.query, round(avg(CASE WHEN s.id IS NULL THEN 0 ELSE 1 END), 6) AS coverage FROM g LEFT JOIN s ON s.query = g.query AND s.id = g.id GROUP BY g.query)
    SELECT c.query, coverage, string_agg(CAST(id AS VARCHAR), '|' ORDER BY rank) AS signature FROM c JOIN r ON r.query = c.query AND rank <= 3 GROUP BY c.query, coverage""")
def eval_path_coverage(spark, sf_dir):
    found = _ranked(spark, sf_dir).select("query", "rank", F.array("id").alias("nodes"))
    ideal = P.table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.col("source").alias("query"), F.col("doc_id").alias("id"))
    return evaluate.path_coverage(found, ideal).join(evaluate.path_signature(found), "query")
