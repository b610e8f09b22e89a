"""The registered queries and the pipeline over whole small tables: the contracts' columns, a row for each document or page, and SQL where there is some."""

import os

import corpus_pipeline
import pandas as pd
import pytest
from codeweave.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
DOCS = {
    "op1_splitters": "doc_id size text_crc32 law shard slot grown_shard", "op4_lempel_ziv": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op5_simhash": "doc_id fingerprint component_id",
    "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op9_gru": "doc_id held_out n_tokens n_known train_tokens base_score score", "op11_fim": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256", "op13_pieces": "doc_id held_out lang_pred score",
}


@pytest.mark.parametrize("name", DOCS)
def test_a_row_for_each_document(spark, name):
    found = QUERIES[name](spark, DATA)
    assert found.columns == DOCS[name].split()
    want = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id")
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(r.doc_id for r in want.collect())


def test_rows_of_pages_and_lists(spark):
    n = spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert QUERIES["op6_html"](spark, DATA).where("n_chars > 0").count() == n
    assert QUERIES["op10_warc"](spark, DATA).where("digest_ok").count() == 2 * n
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert 0 < QUERIES["op2_resampling"](spark, DATA).count() <= docs
    assert {"doc_id", "first_doc_id"} <= set(QUERIES["op3_chunks"](spark, DATA).columns)
    assert QUERIES["op8_latent"](spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple("none" if pd.isna(v) else str(int(v)) if not isinstance(v, str) else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_the_pipeline_runs_whole(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA).collect()
    assert 0 < len(out) < docs.count() and len({r.doc_id for r in out}) == len(out)
    assert {r.doc_id for r in out} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontaminate", "tokenize"]
