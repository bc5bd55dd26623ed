"""Items of JSON documents that are too large for one task, found in parallel.

A document is read in pieces that end at each ``}``, so Spark splits the file at any byte. Whether a piece starts inside
a string is the parity of the quotes before it, and its depth is the sum of the brackets before it that are outside of
strings; both are summed inside a split for either state at its start, and over the splits of a file by a window of one
row a split. With both known, an object of the list starts where a piece outside of strings has the list's depth.

Nothing is taken on trust: a document is split only if each item is sound JSON, what stands between items is a comma,
and the document without its items is sound JSON too. All others are put together again and left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import saved

SPLIT = ["_source_file", "_block"]


def _count(text: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{letters}]", ""))


def quotes(piece: Column) -> Column:
    """Quotes of a piece that are not escaped."""
    return _count(F.regexp_replace(piece, r"(?s)\\.", ""), '"')


def depth_change(piece: Column, inside: bool) -> Column:
    """Brackets opened less brackets closed outside of strings, if the piece starts inside a string or not."""
    text = F.regexp_replace(piece, r"(?s)\\.", "")
    if inside:
        text = F.regexp_replace(text, r'\A[^"]*+(?:"|\z)', "")
    text = F.regexp_replace(text, r'"[^"]*+(?:"|\z)', "")
    return _count(text, r"\[{") - _count(text, r"\]}")


def split_items(spark: SparkSession, path: str | list[str], key: str, larger_than: int) -> tuple[DataFrame, DataFrame]:
    """Items of files of more than ``larger_than`` bytes, and the documents that could not be split.

    A file is one document: a list of objects, or an object with such a list under ``key``. The first result has
    (_source_file, _item_num, item), the item's text; the second (value), the text of each other document: broken ones,
    and lists with anything but objects. Memory: the pieces of one item, or of one document that is not split.
    """
    order = Window.partitionBy(*SPLIT).orderBy("_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pieces = spark.read.option("lineSep", "}").text(path).filter(F.col("_metadata.file_size") > larger_than)
    pieces = pieces.select(
        "value",
        F.col("_metadata.file_path").alias("_source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_file_size"),
        F.monotonically_increasing_id().alias("_id"),
        (quotes(F.col("value")) % 2).alias("_swap"),
        depth_change(F.col("value"), False).alias("_out"),
        depth_change(F.col("value"), True).alias("_in"),
    )
    # the bracket at which a piece ends counts where that end is outside of strings
    pieces = pieces.withColumns({"_out": F.col("_out") - (1 - F.col("_swap")), "_in": F.col("_in") - F.col("_swap")})
    pieces = pieces.withColumn("_start", F.coalesce(F.sum("_swap").over(before), F.lit(0)) % 2)
    pieces = pieces.withColumns(
        {f"_step{s}": F.when(F.col("_start") == s, F.col("_out")).otherwise(F.col("_in")) for s in (0, 1)}
    )
    pieces = pieces.withColumns({f"_depth{s}": F.coalesce(F.sum(f"_step{s}").over(before), F.lit(0)) for s in (0, 1)})
    pieces = saved(pieces.drop("_out", "_in"), "json-pieces")

    by_file = Window.partitionBy("_source_file").orderBy("_block")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    splits = pieces.groupBy(*SPLIT).agg(
        F.sum("_swap").alias("_swaps"),
        *[F.sum(f"_step{s}").alias(f"_steps{s}") for s in (0, 1)],
        F.sum(F.octet_length("value") + 1).alias("_bytes"),
        F.max("_file_size").alias("_file_size"),
    )
    splits = splits.withColumn("_open", F.coalesce(F.sum("_swaps").over(earlier), F.lit(0)) % 2)
    own = F.when(F.col("_open") == 0, F.col("_steps0")).otherwise(F.col("_steps1"))
    splits = splits.withColumn("_base", F.coalesce(F.sum(own).over(earlier), F.lit(0)))
    splits = splits.withColumn("_rest", F.sum("_bytes").over(Window.partitionBy("_source_file")) - F.col("_file_size"))
    splits = saved(splits.select(*SPLIT, "_open", "_base", "_rest"), "json-splits")

    def chosen(name: str) -> Column:
        return F.when(F.col("_open") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    placed = pieces.join(splits, SPLIT).select(
        *SPLIT,
        "_id",
        "value",
        F.struct("_block", "_id").alias("_at"),
        (F.col("_open") != F.col("_start")).alias("_inside"),
        (F.col("_base") + chosen("_depth")).alias("_depth"),
        chosen("_step").alias("_step"),
    )
    # where the list begins: a bracket at depth 0, or the key at depth 1
    keyed = rf'(?s)\A(.*?)(?<!\\)"{key}"\s*:\s*\['
    key_depth = F.col("_depth") + depth_change(F.regexp_extract("value", keyed, 1), False)
    level = F.when((F.col("_depth") == 0) & F.col("value").rlike(r"\A\s*\["), 1).when(
        F.col("value").rlike(keyed) & (key_depth == 1), 2
    )
    starts = placed.filter(~F.col("_inside") & level.isNotNull()).groupBy("_source_file")
    starts = starts.agg(F.min(F.struct("_at", level.alias("level"))).alias("_list"))
    known = saved(splits.join(starts, "_source_file", "left"), "json-lists")

    listed = placed.join(known.select(*SPLIT, "_list"), SPLIT)
    at_list = F.col("_at") == F.col("_list._at")
    prefix = F.when(F.col("_list.level") == 1, F.regexp_extract("value", r"\A\s*\[", 0)).otherwise(
        F.regexp_extract("value", keyed, 0)
    )
    listed = listed.withColumn("_prefix", F.when(at_list, prefix).otherwise(""))
    text = F.substr("value", F.length("_prefix") + 1)
    between = at_list | ((F.col("_at") > F.col("_list._at")) & ~F.col("_inside") & (F.col("_depth") == F.col("_list.level")))
    kind = (
        F.when(~between, "part")
        .when(at_list & text.rlike(r"\A\s*\{") | ~at_list & text.rlike(r"\A\s*,\s*\{"), "item")
        .when(text.rlike(r"\A\s*\]"), "end")
        .otherwise("odd")
    )
    kinds = saved(listed.withColumns({"_text": text, "_kind": kind}), "json-kinds")
    # the list ends at its first closing bracket; what looks like an item after it is none
    ends = kinds.filter("_kind = 'end'").groupBy("_source_file").agg(F.min("_at").alias("_end"))
    known = known.join(ends, "_source_file", "left")
    body = kinds.join(known.select(*SPLIT, "_end"), SPLIT).filter("_list is not null and _end is not null")
    inner = body.filter("_at >= _list._at and _at < _end")
    counts = inner.groupBy(*SPLIT).agg(
        F.count_if(F.col("_kind") == "item").alias("_items"), F.count_if(F.col("_kind") == "odd").alias("_odd")
    )
    counts = counts.withColumn("_earlier", F.coalesce(F.sum("_items").over(earlier), F.lit(0)))

    number = F.col("_earlier") + F.sum((F.col("_kind") == "item").cast("int")).over(order) - 1
    alone = (F.col("_kind") == "item") & (
        F.col("_step") + F.when(at_list, 0).otherwise(F.col("_depth")) == F.col("_list.level")
    )
    own_text = F.when(F.col("_kind") == "item", F.regexp_replace("_text", r"\A\s*,?\s*", "")).otherwise(F.col("value"))
    numbered = inner.join(counts.select(*SPLIT, "_earlier"), SPLIT).select(
        *SPLIT, number.alias("_item_num"), alone.alias("_alone"), F.struct("_at", own_text.alias("text")).alias("_part")
    )
    whole = numbered.filter("_alone").select(*SPLIT, "_item_num", F.col("_part.text").alias("item"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda x: x["text"]), "}")
    several = numbered.filter("not _alone").groupBy("_source_file", "_item_num")
    several = several.agg(F.min("_block").alias("_block"), joined.alias("item")).select(*whole.columns)
    items = whole.unionByName(several).withColumn("item", F.concat("item", F.lit("}")))
    items = saved(items.withColumn("_sound", F.try_parse_json("item").isNotNull()), "json-items")

    # a document without its items: the text up to its list and from the list's end on
    outer = body.filter("_at <= _list._at or _at >= _end")
    cut = at_list & (F.col("_at") != F.col("_end"))
    outer = outer.withColumn("_text", F.when(cut, F.col("_prefix")).otherwise(F.concat("value", F.lit("}"))))
    frames = outer.groupBy("_source_file").agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_parts"))
    frame = F.array_join(F.transform("_parts", lambda x: x["_text"]), "")
    files = known.groupBy("_source_file").agg(F.max("_rest").alias("_rest"))
    frames = frames.join(files, "_source_file")
    # a file that does not end at a bracket has one byte less than its pieces with theirs
    frame = F.when(F.col("_rest") == 0, frame).when(F.col("_rest") == 1, F.left(frame, F.length(frame) - 1))
    bad = items.filter("not _sound").select("_source_file").union(counts.filter("_odd > 0").select("_source_file")).distinct()
    good = frames.filter(F.try_parse_json(frame).isNotNull()).select("_source_file").join(bad, "_source_file", "left_anti")
    status = saved(known.select(*SPLIT, "_rest").join(good.withColumn("_good", F.lit(True)), "_source_file", "left"), "json-files")

    items = items.join(status.filter("_good"), SPLIT, "left_semi").select("_source_file", "_item_num", "item")
    others = pieces.join(status.filter("_good is null"), SPLIT).groupBy("_source_file")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_id", "value"))), lambda x: x["value"]), "}")
    others = others.agg(joined.alias("_text"), F.max("_rest").alias("_rest"))
    return items, others.select(F.concat("_text", F.when(F.col("_rest") == 0, "}").otherwise("")).alias("value"))
