"""Registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from tissuegrid.llm.queries import ORACLES, QUERIES

PATH = "/root/testdata/sf0.001"


# queries with a row for something else than a row of their table
OTHER_ROWS = {"op11_chat", "op12_spellings"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_returns_every_row(spark, name):
    source = "embeddings" if name.startswith("op8") else "documents"
    got = QUERIES[name](spark, PATH)
    rows = got.collect()
    assert name in OTHER_ROWS or len(rows) == spark.read.parquet(f"{PATH}/{source}.parquet").count()
    if name in ORACLES:
        con = duckdb.connect()
        for table in ("documents", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{PATH}/{table}.parquet'")
        result = con.execute(ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(map(str, (tuple(r[n] for n in names) for r in rows))) == sorted(map(str, result.fetchall()))


def test_stages_keep_their_promises(spark, tmp_path):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, PATH).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(docs.columns) == sorted(columns)
    assert sizes[0] >= sizes[1] == sizes[2] > sizes[3] and sizes[4] == sizes[5]
    assert docs.where("not round_trip").count() == 0


def test_run_has_the_last_stage_rows(spark):
    got = corpus_pipeline.run(spark, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and got.count() > 0


def test_stages_on_awkward_documents(spark, tmp_path):
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, " ", "en", "a", 1), (3, " ", "en", "a", 1), (4, "word " * 5000, "en", "b", 25000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _id int")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, PATH).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, empty, PATH).count() == 0
