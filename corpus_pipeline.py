"""The corpus pipeline: documents in, shard places of the training mix out.

Each stage gets what its predecessor kept, as a table, and returns a table; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, ngram_join, shards, toxicity
from tidemark.llm.queries import quality_weights
from tidemark.session import saved

SHARDS = 24
TOXIC = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; learned from labelled documents that are not held out."""
    labels = _table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    grammar = toxicity.learn(docs, labels)
    # the score gets a name that no column of the documents has
    free = "score" + "_" * max(len(c) for c in docs.columns)
    return toxicity.with_scores(docs, grammar, free).filter(F.col(free) < TOXIC).drop(free)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that n-gram links connect, the one with the least id.

    A row is known by its id: rows that share an id stay or go together, and of repeated rows with an
    id and text that stay, one stays. Rows without an id stay.
    """
    groups = ngram_join.similar_components(docs)
    least = groups.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id is not null")
    stay = named.join(least, "doc_id", "left_semi")
    return stay.dropDuplicates(["doc_id", "text"]).select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs, quality_weights(_table(spark, sf_dir, "labels")))


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of the mix."""
    return shards.shard_rows(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: Toxicity and sharding are not expressible in SQL. tests/llm/test_stages.py checks decontamination, the n-gram join and
#: mixing against brute force, and what toxicity and sharding must keep to.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's result written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
