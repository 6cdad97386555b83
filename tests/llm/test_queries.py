"""The registered queries: SQL where there is some, the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from seriesmith.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in columns]
    assert ordered(tuple(r[c] for c in columns) for r in df.collect()) == ordered(tuple(r[i] for i in at) for r in found.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SF), f"test-{name}")
        after = docs.count()
        assert docs.columns == columns if name != "sharding" else docs.columns == [*columns, "slot", "shard"]
        assert 0 < after and (name in ("mixing", "sharding") or after <= before)
        before = after
    assert docs.where("shard IS NULL").count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    more = spark.createDataFrame([(None, "no id here", "en", None, 10), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], docs.schema)
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"file://{tmp_path}/{t}.parquet")
    docs.union(docs.limit(5)).union(more).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() > 0
