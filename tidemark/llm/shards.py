"""Sharding by balanced label propagation.

Documents with equal texts are linked. Each document starts in the shard that a hash of its id
gives; in rounds, linked documents move to the shard that most of their neighbours are in, as far
as that shard has room. Room is counted for linked documents only: documents without a link are
dealt out at the end and fill every shard to its exact number of rows.

Members of a group that are in the same shard are exchangeable, so a round joins and moves cells
(group, shard, how many), at most one per shard and group: a group with a third of all rows is
as many rows as there are shards. Rows get their places once, at the end, by ranks that are
summed over buckets; no window runs over a shard or a large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.spread import offsets
from tidemark.session import saved

OVERHEAD = 8
ROUNDS = 10
BROADCAST_GROUPS = 100_000


def _pick(values: list[int], at: Column) -> Column:
    """Element of a list of shards; ``at`` is a shard number."""
    return F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values)), at + 1)


def _root(n: int) -> int:
    return int(n**0.5) + 1


def _accepted(moves: DataFrame, room: list[int]) -> DataFrame:
    """``moves`` (group, shard, n, to) with ``moved``, so that no shard takes more than its room.

    Cells go in order of a hash. Bucket sums tell which buckets fit; only the bucket in which the room
    of a shard ends is looked at cell by cell.
    """
    moves = moves.withColumn("_b", F.pmod(F.xxhash64("group", "shard"), F.lit(1024)))
    sums = offsets(moves, ["to"], "_b", F.col("n")).select("to", "_b", "before", "inside")
    placed = moves.join(sums, ["to", "_b"]).withColumn("_room", _pick(room, F.col("to")) - F.col("before"))
    whole = placed.filter("inside <= _room").withColumn("moved", F.col("n"))
    inside = Window.partitionBy("to", "_b").orderBy("group", "shard").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_room") - F.coalesce(F.sum("n").over(inside), F.lit(0))
    split = placed.filter("inside > _room and _room > 0").withColumn("moved", F.greatest(F.lit(0), F.least(left, F.col("n"))))
    return whole.unionByName(split).select("group", "shard", "n", "to", "moved")


def propagate(cells: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """Move ``cells`` (group, shard, n) together, towards at most ``quota`` linked rows in a shard.

    A shard takes what it has room for and half as many as want to leave it, so that full shards swap
    members. The driver sees two numbers per shard and round. Ends when nothing moves.
    """
    cells = saved(cells, "shard-cells")
    for _ in range(rounds):
        loads = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        open_to = [int(loads.get(s, 0) <= quota) for s in range(shards)]
        rank = F.struct(F.col("n"), F.xxhash64("group", "shard"), F.col("shard"))
        ranked = cells.withColumn("_rank", rank)
        best = ranked.filter(_pick(open_to, F.col("shard")) > 0).groupBy("group").agg(F.max("_rank").alias("_best"))
        moves = ranked.join(best, "group").filter("_rank < _best").select("group", "shard", "n", F.col("_best.shard").alias("to"))
        leave = {r["shard"]: r["n"] for r in moves.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [max(0, quota - loads.get(s, 0)) + leave.get(s, 0) // 2 for s in range(shards)]
        moved = saved(_accepted(moves, room).filter("moved > 0"), "shard-moves")
        if moved.isEmpty():
            break
        cells = saved(
            cells.unionByName(moved.select("group", F.col("to").alias("shard"), F.col("moved").alias("n")))
            .unionByName(moved.select("group", "shard", (-F.col("moved")).alias("n")))
            .groupBy("group", "shard")
            .agg(F.sum("n").alias("n"))
            .filter("n > 0"),
            "shard-cells",
        )
    return cells


def _trimmed(cells: DataFrame, quotas: list[int]) -> DataFrame:
    """``cells`` without what a shard has beyond its quota; that is dealt out like rows without a link."""
    loads = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    excess = [max(0, loads.get(s, 0) - q) for s, q in enumerate(quotas)]
    if not any(excess):
        return cells
    over = _accepted(cells.filter(_pick(excess, F.col("shard")) > 0).withColumn("to", F.col("shard")), excess)
    less = cells.unionByName(over.select("group", "shard", (-F.col("moved")).alias("n")))
    return saved(less.groupBy("group", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "shard-cells")


def shard_rows(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per row of ``docs`` (doc_id, text).

    Other columns are not read. Shards are 0 to ``shards`` - 1 and their row counts at most one
    apart; slots of a shard are 0, 1, 2, ... ``size`` is the bytes of the text plus 8. A null text has
    no bytes and links with null and empty texts. Rows that repeat are rows like others. A rerun gives
    the same places, up to which of two equal rows has which.
    """
    text = F.coalesce("text", F.lit(""))
    base = saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("group"),
        ).withColumn("_start", F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards)).cast("int")),
        "shard-rows",
    )
    total = base.count()
    first = base.groupBy("group", F.col("_start").alias("shard")).agg(F.count("*").alias("n"))
    large = first.groupBy("group").agg(F.sum("n").alias("_total")).filter("_total > 1")
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    cells = propagate(first.join(large, "group").select("group", "shard", "n"), shards, total // shards, rounds)
    cells = _trimmed(cells, quotas)

    # where a cell's rows begin in its shard
    cells = cells.withColumn("_b", F.pmod(F.xxhash64("group"), F.lit(1024)))
    starts = offsets(cells, ["shard"], "_b", F.col("n")).select("shard", "_b", "before")
    inside = Window.partitionBy("shard", "_b").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.join(starts, ["shard", "_b"]).withColumn("_slot", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    in_group = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)  # one row per shard
    ends = placed.withColumn("_end", F.sum("n").over(in_group))
    groups = saved(
        ends.groupBy("group").agg(
            F.sum("n").alias("_total"), F.sort_array(F.collect_list(F.struct("_end", "shard", "n", "_slot"))).alias("_cells")
        ),
        "shard-groups",
    )
    # a few groups reach the rows without moving these; else a large group's rows are split by Spark
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    loads = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}

    # linked rows: rank in the group, by parts of a large group
    parts = F.floor(F.sqrt("_total") / 4) + 1
    base = base.drop("_start")
    linked = base.join(groups.select("group", "_total"), "group").withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit("part")), parts))
    linked = linked.repartition("group", "_part")  # else the join's partitions by group alone would do for Spark
    before = offsets(linked, ["group"], "_part", F.lit(1)).select("group", "_part", "before")
    in_part = Window.partitionBy("group", "_part").orderBy("doc_id")
    numbered = linked.withColumn("_number", F.row_number().over(in_part) - 1)
    ranked = numbered.join(before, ["group", "_part"]).withColumn("_rank", F.col("before") + F.col("_number"))
    cell = F.get(F.filter("_cells", lambda c: c["_end"] > F.col("_rank")), 0)
    with_cell = ranked.join(groups.select("group", "_cells"), "group").withColumn("_cell", cell)
    placed = with_cell.filter("_cell is not null").select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("_cell.shard").alias("shard"),
        (F.col("_cell._slot") + F.col("_rank") - F.col("_cell._end") + F.col("_cell.n")).alias("slot"),
    )

    # the rest: rank among all of it, cut into what each shard still takes
    spare = with_cell.filter("_cell is null").select(*base.columns)
    single = base.join(groups.select("group"), "group", "left_anti").unionByName(spare)
    single = single.withColumn("_b", F.pmod(F.xxhash64("group", "doc_id"), F.lit(4 * _root(total))))
    before = offsets(single, [], "_b", F.lit(1)).select("_b", "before")
    in_bucket = Window.partitionBy("_b").orderBy("group", "doc_id")
    ranked = single.withColumn("_number", F.row_number().over(in_bucket) - 1).join(before, "_b")
    ranked = ranked.withColumn("_rank", F.col("before") + F.col("_number"))
    filled, upto = [loads.get(s, 0) for s in range(shards)], []
    for s in range(shards):
        upto.append((upto[-1] if upto else 0) + quotas[s] - filled[s])
    edges = F.array(*(F.lit(int(x)).cast("long") for x in upto))
    shard = F.size(F.filter(edges, lambda e: e <= F.col("_rank")))
    alone = ranked.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (_pick(filled, F.col("shard")) + F.col("_rank") - _pick([0, *upto[:-1]], F.col("shard"))).alias("slot"),
    )
    return placed.unionByName(alone)
