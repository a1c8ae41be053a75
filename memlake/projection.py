"""The driver's tables seen as memories, tags, edges, turns and claims (SQL text is in ``VIEWS``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T0 = 1_704_067_200_000
NOW = T0 + 90 * 86_400_000
CLASSES = ("fact", "decision", "preference", "event", "observation", "other")

# The same projections for DuckDB, as common table expressions.
VIEWS = {
    "memory": f"""SELECT 'memory:' || d.doc_id AS id, d.doc_id, d.text AS content, d.lang, d.source, e.embedding,
        CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE {T0} + d.doc_id * 3600000 END AS event_time,
        {T0} + d.doc_id * 60000 AS created_at, CAST(ceil(d.n_chars / 4.0) AS BIGINT) AS token_count
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "tagged": """SELECT 'memory:' || doc_id AS in_id, 'tag:lang/' || lang AS out_id FROM documents
        UNION ALL SELECT 'memory:' || doc_id, 'tag:source/' || source FROM documents""",
    "owned": f"""SELECT 'memory:' || l.doc_id AS in_id, 'domain:kb' AS out_id, {T0} + l.doc_id * 60000 AS owned_at,
        l.toxic = 1 AS superseded, ['fact','decision','preference','event','observation','other'][1 + l.doc_id % 6] AS classification
        FROM labels l SEMI JOIN documents d ON d.doc_id = l.doc_id
        UNION ALL SELECT 'memory:' || doc_id, 'domain:log', {T0} + doc_id * 60000, NULL, NULL FROM documents""",
    "reinforces": """SELECT 'memory:' || d.doc_id AS in_id, 'memory:' || f.first AS out_id FROM documents d
        JOIN (SELECT text, min(doc_id) AS first FROM documents GROUP BY text) f ON f.text = d.text WHERE d.doc_id > f.first""",
    "turn": f"""SELECT conv_id, turn, role, text, conv_id % 7 AS user_id, {T0} + conv_id * 60000 + turn * 1000 AS created_at,
        CAST(ceil(length(text) / 4.0) AS BIGINT) AS token_count FROM conversations""",
    "claim": """SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS valid_from,
        epoch_us(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) // 1000 AS valid_to FROM events""",
    "child_of": """SELECT 'order:' || o_orderkey AS in_id, 'customer:' || o_custkey AS out_id FROM orders
        UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
        UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation""",
}


def views(*names: str) -> str:
    """A WITH clause of the named projections."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return docs.join(vectors, docs.doc_id == vectors.vec_id, "left").select(
        F.concat(F.lit("memory:"), F.col("doc_id").cast("string")).alias("id"), "doc_id", F.col("text").alias("content"), "lang", "source",
        "embedding", F.when(F.col("doc_id") % 10 != 0, F.lit(T0) + F.col("doc_id") * 3_600_000).alias("event_time"),
        (F.lit(T0) + F.col("doc_id") * 60_000).alias("created_at"), F.ceil(F.col("n_chars") / 4.0).alias("token_count"),
    )


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        _id("memory", "doc_id").alias("in_id"),
        F.explode(F.array(F.concat(F.lit("tag:lang/"), "lang"), F.concat(F.lit("tag:source/"), "source"))).alias("out_id"),
    )


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id", "left_semi")
    classes = F.array(*[F.lit(c) for c in CLASSES])
    at = (F.lit(T0) + F.col("doc_id") * 60_000).alias("owned_at")
    kb = labels.select(
        _id("memory", "doc_id").alias("in_id"), F.lit("domain:kb").alias("out_id"), at, (F.col("toxic") == 1).alias("superseded"),
        F.get(classes, (F.col("doc_id") % 6).cast("int")).alias("classification"),
    )
    log = docs.select(
        _id("memory", "doc_id").alias("in_id"), F.lit("domain:log").alias("out_id"), at,
        F.lit(None).cast("boolean").alias("superseded"), F.lit(None).cast("string").alias("classification"),
    )
    return kb.unionByName(log)


def reinforces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of a text to the first; texts meet by hash, so whole texts are not shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    first = docs.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "key").where("doc_id > first").select(_id("memory", "doc_id").alias("in_id"), _id("memory", "first").alias("out_id"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", (F.col("conv_id") % 7).alias("user_id"),
        (F.lit(T0) + F.col("conv_id") * 60_000 + F.col("turn") * 1000).alias("created_at"), F.ceil(F.length("text") / 4.0).alias("token_count"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    chain = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    millis = lambda c: F.unix_millis(c.cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", millis(F.col("ts")).alias("valid_from"),
        millis(F.lead("ts").over(chain)).alias("valid_to"),
    )


def child_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda n, a, ka, b, kb: table(spark, sf_dir, n).select(_id(a, ka).alias("in_id"), _id(b, kb).alias("out_id"))
    return (
        get("orders", "order", "o_orderkey", "customer", "o_custkey")
        .unionByName(get("customer", "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(get("nation", "nation", "n_nationkey", "region", "n_regionkey"))
    )
