"""Mixing sources to target weights.

Each source gets a target in words by its weight; a target stops at a multiple of what the source
has, and the excess is shared again by weight (the sources that stop are found in order of size
per weight, where each step is a prefix sum). A target is met by complete epochs of the source
first, then by an Efraimidis-Spirakis sample: documents in order of exponential keys,
``-ln(u) / quality``, up to the word budget.

The order is never built. Keys fall into buckets (as many as the root of the source's documents);
sums of the buckets tell the one in which the budget ends, and only that one is sorted. What
comes out is a cut per source, and a document's share follows from its own key and the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.spread import offsets, unit
from tidemark.session import saved

BETWEEN = r"[\x20\x09-\x0D]+"
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")).cast("long")


def _source_key(source: Column) -> Column:
    """Text that orders sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(measured: DataFrame, cycle: list[int], percent: int, most: int) -> DataFrame:
    """(_source, source_size, target, epochs, _left, _buckets), one row per source.

    ``measured`` has _source and size. All sums are whole numbers, so the only rounding is the
    division at the end.
    """
    sizes = measured.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    by_name = Window.orderBy("_source")
    every = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    weighed = sizes.withColumn("_w", weight.cast("long"))
    by_room = Window.orderBy(F.col("source_size") / F.col("_w"), "_source")
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every)
    before = weighed.withColumns(
        {
            "_all": total * percent,
            "_size_before": F.coalesce(F.sum("source_size").over(earlier), F.lit(0)),
            "_w_left": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(earlier), F.lit(0)),
        }
    )
    full = F.lit(100 * most) * F.col("source_size") * F.col("_w_left") <= F.col("_w") * (
        F.col("_all") - F.lit(100 * most) * F.col("_size_before")
    )
    stops = before.withColumn("_full", F.min(full.cast("int")).over(by_room.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    rest = F.col("_all") - F.lit(100 * most) * F.sum(F.when(F.col("_full"), F.col("source_size")).otherwise(0)).over(every)
    shared = (F.col("_w") * rest).cast("double") / (F.lit(100) * F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(every))
    words = F.floor("target")
    return (
        stops.withColumn("target", F.when(F.col("_full"), (F.col("source_size") * most).cast("double")).otherwise(shared))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .select(
            "_source",
            "source_size",
            "target",
            "epochs",
            (words - F.col("epochs") * F.col("source_size")).alias("_left"),
            F.ceil(F.sqrt("_n")).cast("long").alias("_buckets"),
        )
    )


NEW = ["size", "source_size", "target", "taken"]


def with_taken(
    docs: DataFrame, quality: DataFrame | None = None, cycle: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, seed: str = "mix"
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted).

    ``docs`` has doc_id, text and source; all its columns are kept as they are, whatever their names, except that
    columns of the new names are replaced. ``quality`` (doc_id, weight) gives sampling weights; ids without one, and
    null or not positive weights, weigh 1. Sources by code point, null last, get the weights of
    ``cycle`` in turn and share ``percent`` per cent of all words, at most ``most`` times
    their own. The document in which a budget ends gives as many words as are left; if rows repeat
    it (same id and size), they share them evenly, rounded down. Null texts, empty texts and sources
    without words take nothing. The result depends on ids, sizes, weights and ``seed`` only.
    """
    taken = _taken(docs, quality, cycle, percent, most, seed)
    return taken.select(*(F.col("_user")[c].alias(c) for c in docs.columns if c not in NEW), *NEW)


def _taken(docs: DataFrame, quality: DataFrame | None, cycle: tuple[int, ...], percent: int, most: int, seed: str) -> DataFrame:
    """The columns of ``docs`` as one, ``_user``, beside the new ones; so no name of a user can clash."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_user"),
        _source_key(F.col("source")).alias("_source"),
        n_words(F.col("text")).alias("size"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
    )
    if quality is None:
        weights = None
    else:
        weights = quality.filter("weight > 0 and doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("_id")).agg(F.max("weight").cast("double").alias("_weight"))

    def keyed(df: DataFrame) -> DataFrame:
        if weights is None:
            df = df.withColumn("_weight", F.lit(1.0))
        else:
            df = df.join(weights, "_id", "left").withColumn("_weight", F.coalesce("_weight", F.lit(1.0)))
        return df.withColumn("_key", -F.log(unit(F.lit(seed), F.col("_id"))) / F.col("_weight"))

    narrow = saved(keyed(rows.select("_source", "size", "_id")).drop("_weight"), "mix-sizes")
    mix = saved(targets(narrow, list(cycle), percent, most), "mix-targets")
    mix = F.broadcast(mix) if mix.count() <= BROADCAST_SOURCES else mix
    place = F.least(F.floor((1 - F.exp(-F.col("_key"))) * F.col("_buckets")), F.col("_buckets") - 1)
    placed = narrow.join(mix, "_source").filter("_left > 0 and size > 0").withColumn("_bucket", place)
    ends = (
        offsets(placed, ["_source", "_left"], "_bucket", F.col("size"))
        .filter("before < _left and _left <= before + inside")
        .select("_source", "_bucket", F.col("before").alias("_before"))
    )
    same = placed.join(ends, ["_source", "_bucket"]).groupBy("_source", "_left", "_before", "_key", "_id", "size").agg(F.count("*").alias("_m"))
    order = Window.partitionBy("_source").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("_m") * F.col("size")
    start = F.col("_before") + F.coalesce(F.sum(words).over(order), F.lit(0))
    cuts = (
        same.withColumn("_start", start)
        .filter((F.col("_start") < F.col("_left")) & (F.col("_left") <= F.col("_start") + words))
        .select(
            "_source",
            F.col("_key").alias("_cut_key"),
            F.col("_id").alias("_cut_id"),
            F.col("size").alias("_cut_size"),
            F.floor((F.col("_left") - F.col("_start")) / F.col("_m")).alias("_cut_words"),
        )
    )
    plan = saved(mix.join(cuts, "_source", "left"), "mix-cuts")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    mine, cut = F.struct("_key", "_id", "size"), F.struct("_cut_key", "_cut_id", "_cut_size")
    part = (
        F.when(F.col("_cut_key").isNull(), 0)
        .when(mine < cut, F.col("size"))
        .when(mine == cut, F.col("_cut_words"))
        .otherwise(0)
    )
    result = keyed(rows).join(plan, "_source").withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
    return result.select("_user", *NEW)


def mixed(
    docs: DataFrame, quality: DataFrame | None = None, cycle: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, seed: str = "mix"
) -> DataFrame:
    """The rows of the mix: ``docs`` with each row as often as its words are taken; its columns stay as they are.

    Whole rows only: the document in which a budget ends comes once more if at least half of it is
    taken. Rows without words are in no mix.
    """
    taken = _taken(docs, quality, cycle, percent, most, seed)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    rows = taken.select("_user", times.alias("_times")).filter("_times > 0")
    return rows.select("_user", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_n")).select("_user.*")
