"""The pipeline's stages and the registered queries on the smallest tables."""

import hashlib

import pytest

pytest.importorskip("memlake.llm.queries")

import corpus_pipeline  # noqa: E402
from memlake.llm import queries  # noqa: E402
from oracle import connect, difference  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_query_returns_each_row_once(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    table = {"op2_url_digests": "pages"}.get(name, "documents")
    if name not in ("op8_latent_decontamination", "op10_token_rollup", "op11_filter_audit", "op13_lexical_search"):
        key = "page_id" if table == "pages" else "doc_id"
        want = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
        assert sorted(r[0] for r in rows.select(key).collect()) == want
    else:
        assert rows.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name]) == ""


def test_stages_keep_their_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, docs.count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() <= last
        last = docs.count()
        if name == "toxicity":
            kept = {r.doc_id for r in docs.collect()}
            clean = [i for i, t in labels.items() if t == 0]
            assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    out = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(out) == set(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in out.items())
    run = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.ids_sha256) for r in run} == {(i, r.ids_sha256) for i, r in out.items()}


def test_leaked_passages_are_gone_after_the_pipeline(spark):
    passages = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {r.doc_id for r in docs.collect() if any(p in r.text for p in passages)}
    kept = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, SF).collect()}
    assert not held & kept and len(kept) >= 0.9 * (docs.count() - len(held))
