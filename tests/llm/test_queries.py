"""The registered queries against DuckDB, and against each other where SQL has no form."""

import duckdb
import pytest

from snapdeck.llm.oracle import SQL
from snapdeck.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in sorted(cols)) for r in df.collect())
    want = sorted(tuple(str(v) for _, v in sorted(zip(cols, r, strict=True))) for r in cur.fetchall())
    assert got == want


def test_every_operator_has_a_query():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]


def test_pipeline_keeps_its_promises(spark, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    kept, texts = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == cols
        out.write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        texts.append(kept)
    ids = {r.doc_id for r in texts[3].select("doc_id").collect()}
    assert ids == {r.doc_id for r in kept.select("doc_id").distinct().collect()}
    again = {(r.doc_id, r.piece, r.n_words) for r in corpus_pipeline.run(spark, SF).collect()}
    assert again == {(r.doc_id, r.piece, r.n_words) for r in kept.collect()}
    counts = [x.count() for x in texts[:4]]
    assert counts == sorted(counts, reverse=True) and counts[0] < docs.count() and counts[2] < counts[1] and counts[3] < counts[2]
