"""From raw documents to sharded training data, one operator a stage.

Each stage works on all rows its predecessor kept and returns the columns of
documents; the last adds the shard. A stage's rows are written to the shared
folder and read again by the next. Columns may have any names and types; null
ids, repeated rows and empty tables are handled as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, jaccard, language, mixing, sharding
from quire.llm.common import table, whole
from quire.session import durable

#: Share of a document's words below which its language is not accepted.
LEAST_SHARE = 0.5
SHARDS = 24


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with letters, most of whose words are in one language.

    A null or empty text goes. Rows are judged one by one, so repeated rows
    and null ids change nothing; an empty table stays empty.
    """
    found = language.labelled(language.fit(docs), docs)
    named = whole(docs, "text").withColumn("found", found("text"))
    kept = named.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= LEAST_SHARE))
    return kept.select("row.*")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the shard of each row, by its id; a column ``shard`` is replaced."""
    return sharding.with_shard(docs, sharding.topology(SHARDS))


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Learned models, hashes and logarithms decide: no SQL can give these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
