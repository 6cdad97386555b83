"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Its
result is written as Parquet and read again before the next. All but the last return the
columns of ``documents``; the last adds ``slot`` and ``shard``.

1. toxicity: documents that the classifier rejects go.
2. near_duplicates: one document (the smallest id) of each group of five-word-shingle
   Jaccard similarity 0.8 or more stays; texts without words are no duplicates.
3. decontamination: documents that hold a benchmark window go.
4. mixing: documents are repeated or cut to their source's target weight and dealt to
   output shards; rows repeat.
5. sharding: every row gets the shard of its document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesmith.llm import decontaminate, jaccard, mixing, sharding, toxicity
from seriesmith.llm.common import stage, table

#: No SQL expresses the classifier and the seeded draws.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def place_on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place(docs, ["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place_on_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
