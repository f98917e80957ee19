"""Cleaning a corpus: five stages over ``documents``, each on all rows its predecessor kept.

1. toxicity: documents predicted toxic go;
2. near duplicates: one document of each group stays;
3. decontamination: documents that hold benchmark passages go;
4. mixing: each document is repeated as often as its source's target weight asks
   for, and goes when it is taken no time;
5. sharding: the rows get a shard and a slot, uniformly at random, in shards of
   equal size.

All stages but the last return the columns of ``documents``. ``docs`` is a scan of
stored files in every stage, so that rows keep their numbers and no stage has to
store the texts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import decontaminate, mixing, neardup, sharding, toxicity
from spendlens.llm.common import DOCUMENT_COLUMNS, Workspace, table

SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accept(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs.select(*DOCUMENT_COLUMNS), stored=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select(*DOCUMENT_COLUMNS), keep=DOCUMENT_COLUMNS, stored=True)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return mixed.select(*DOCUMENT_COLUMNS, copies.alias("copy")).drop("copy")


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shuffle(docs.select(*DOCUMENT_COLUMNS), SHARDS, stored=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]

#: No SQL: the classifier, the rounding and the shuffle are not expressible; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is stored and read by the next."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return after
        docs = ws.settle(after, name)
