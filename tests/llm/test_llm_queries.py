"""The registered queries of the subpackage and the pipeline on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from helixlake.llm import queries
from helixlake.llm.common import stored, table


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    plain = lambda df: df[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert plain(got).equals(plain(want))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_a_row_for_every_row(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    key = "page_id" if "page_id" in df.columns else "doc_id"
    source = table(spark, sf, "pages" if key == "page_id" else "documents")
    assert sorted(r[0] for r in df.select(key).distinct().collect()) == sorted(r[0] for r in source.select(key).collect())


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf), name)
        if name != "pack":
            assert out.columns == docs.columns
        if name in ("quality", "exact_dedup", "near_dedup"):
            ids = {r[0] for r in docs.select("doc_id").collect()}
            kept = [r[0] for r in out.select("doc_id").collect()]
            assert len(kept) == len(set(kept)) and set(kept) <= ids and len(kept) >= 0.5 * before
        docs = out
    assert docs.filter("offset + length > 4096").count() == 0
