"""The registered queries, their SQL twins and the pipeline, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tests.test_oracles import TABLES, normal
from vigilframe.llm import queries

COLUMNS = {
    "op2_mix_sources": ["doc_id", "size", "source_size", "target", "taken"], "op4_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op5_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op6_quality": ["doc_id", "held_out", "score", "predicted"], "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_pack_documents": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9_lm_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op10_simhash": ["doc_id", "fingerprint", "component_id"],
    "op11_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op12_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert normal(queries.QUERIES[name](spark, sf_dir).toPandas()) == normal(con.sql(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf_dir, name):
    assert name in __spark_entry__.queries()
    out = queries.QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[name]) <= set(out.columns)
    table = "embeddings" if "op4" in name else "documents"
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert out.count() >= n if name == "op8_pack_documents" else out.count() == n


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir).persist()
        assert out.columns == names
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before
        if k == 0:
            assert len(good & after) >= 0.97 * len(good & before)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.columns == COLUMNS["op8_pack_documents"]


def test_stages_take_odd_documents(spark, sf_dir, make_docs, odd):
    """Nulls, empty and long texts, repeated rows, clashing names and no rows at all."""
    docs = make_docs(odd).selectExpr("*", "1 as score", "2 as `__id`", "3 as copies", "4 as label", "5 as fp")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        had = {r.doc_id: r.copies for r in docs.collect()}
        assert all(r.doc_id in had and r.copies == 3 for r in out.collect())
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r[0] for r in odd}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
