"""Scans of landed JSON documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.json_records import split_items

#: Files of one document that are larger are read by several tasks.
SPLIT_BYTES = 64 << 20

# The keys under which a document may keep its list, in order.
ROOT_KEYS = ["data", "results", "items", "tasks", "weeklyPlans", "plans", "content"]


def scan_envelopes(
    spark: SparkSession,
    path: str,
    item: str,
    per_line: bool = False,
    bare_object: bool = False,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Items of ``{"data": [...]}`` or bare-list documents, one document per file or per line.

    ``item`` is the item's schema. With ``bare_object`` an object without a list under
    ``data`` is one item. Other documents, empty ones and broken ones give no rows. Files of lines are split, and so
    are files of one document with more than ``split_bytes``; a smaller document is one task.
    """
    size = F.col("_metadata.file_size")
    if per_line or spark.read.format("binaryFile").load(path).filter(F.col("length") > split_bytes).isEmpty():
        return _parse_envelopes(spark.read.text(path, wholetext=not per_line), item, bare_object)
    items, others = split_items(spark, path, "data", split_bytes)
    docs = spark.read.text(path, wholetext=True).filter(size <= split_bytes).select("value")
    split = items.select(F.from_json("item", f"struct<{item}>").alias("item")).filter(F.col("item").isNotNull())
    return _parse_envelopes(docs.unionByName(others), item, bare_object).unionByName(split.select("item.*"))


def _parse_envelopes(docs: DataFrame, item: str, bare_object: bool) -> DataFrame:
    bare = F.ltrim("value").startswith("[")
    listed = F.from_json("value", f"data array<struct<{item}>>")["data"]
    if bare_object:
        sound = F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull()
        listed = F.coalesce(listed, F.when(sound, F.array(F.from_json("value", f"struct<{item}>"))))
    items = F.when(bare, F.from_json("value", f"array<struct<{item}>>")).otherwise(listed)
    # the inner explode would add a filter that parses the document a second time
    rows = docs.select(F.explode_outer(items).alias("item"))
    return rows.filter(F.col("item").isNotNull()).select("item.*")


def scan_endpoints(spark: SparkSession, paths: dict[str, str], item: str) -> DataFrame:
    """Items of several endpoints, tagged with the endpoint's name."""
    parts = [
        scan_envelopes(spark, path, item).withColumn("endpoint_type", F.lit(name))
        for name, path in paths.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def search_roots(docs: DataFrame, value: str, record: str) -> DataFrame:
    """Rows of the records of each JSON document, in the given record schema.

    A list is taken as it is. Of an object the first list under a known key is
    taken; where there is none, or it is empty, the object itself is the record.
    Any other text gives no rows.
    """
    kind = f"struct<{record}>"
    parsed = docs.select(F.ltrim(value).startswith("{").alias("_braced"), F.try_parse_json(value).alias("_doc"))
    # a list is read in the record schema at once: a list of variants would copy each record first
    lists = [F.try_variant_get("_doc", p, f"array<{kind}>") for p in ["$", *(f"$.{k}" for k in ROOT_KEYS)]]
    # a column of its own, so that its size and its records come from one evaluation
    listed = parsed.select("_braced", "_doc", F.coalesce(*lists).alias("_list"))
    records = F.when(F.size("_list") > 0, F.col("_list")).when(
        F.col("_braced"), F.array(F.try_variant_get("_doc", "$", kind))
    )
    # the inner explode, and a filter on a column that is not exploded, would read the records once more
    rows = listed.select(F.explode_outer(records).alias("r"))
    return rows.filter(F.col("r").isNotNull()).select("r.*")
