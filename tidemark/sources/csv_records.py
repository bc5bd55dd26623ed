"""Records of CSV files whose quoted cells hold line ends, found in parallel.

A line alone does not tell whether it starts inside a quoted cell, so each line is read as a function from the state
before it (outside or inside) to the state after it. There are four such functions: keep, swap, always outside, always inside.
They compose associatively: inside a split by running windows, over the splits of a file by a window of one row a split.
With the state before each split known, every line knows where its record begins, and only the lines of records of
several lines are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import saved

# In an unquoted cell or after a closed one; at the start of a cell; in a quoted cell; after a quote in a quoted cell.
_MIDDLE, _START, _INSIDE, _QUOTE = 0, 1, 2, 3


def ends_inside(line: Column, separator: str, inside: bool = False) -> Column:
    """Whether a line ends inside a quoted cell if it starts inside one (``inside``) or outside.

    A quote opens a cell only at the cell's start; two quotes in a quoted cell are one character of it.
    """

    def text(state: Column, t: Column) -> Column:
        moved = F.when(F.endswith(t, F.lit(separator)), _START).otherwise(_MIDDLE)
        return F.when((state == _INSIDE) | (t == ""), state).otherwise(moved)

    def quote(state: Column) -> Column:
        return F.when(state == _INSIDE, _QUOTE).when(state == _MIDDLE, _MIDDLE).otherwise(_INSIDE)

    parts = F.split(line, '"')
    first = F.lit(_INSIDE if inside else _START)
    before_last = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), first, lambda s, t: quote(text(s, t)))
    found = text(before_last, F.element_at(parts, -1)) == _INSIDE
    return F.when(F.contains(line, F.lit('"')), found).otherwise(F.lit(inside))


def csv_records(spark: SparkSession, path: str | list[str], separator: str, encoding: str) -> DataFrame:
    """(record, _row_num, _source_file) of all records but the first, the header, of each file below ``path``.

    Records that are blank are left out and not counted. Line ends are "\\n" or "\\r\\n". Memory: the lines of one record.
    """
    split = ["_source_file", "_block"]
    order = Window.partitionBy(*split).orderBy("_id")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    functions = lines.select(
        "*",
        ends_inside(F.col("value"), separator).cast("int").alias("_out"),
        ends_inside(F.col("value"), separator, True).cast("int").alias("_in"),
        (F.trim(F.regexp_replace("value", r"[\t\r]", " ")) == "").alias("_blank"),
    )
    # the state at the end of each line for both states at the start of the split
    running = _run(functions, order)
    before = {p: F.coalesce(F.lag(F.col(f"_end{p}")).over(order), F.lit(p)) for p in (0, 1)}
    running = running.withColumns({f"_start{p}": before[p] for p in (0, 1)})
    opens = {p: (F.col(f"_start{p}") == 0) & ~(F.col("_blank") & (F.col(f"_end{p}") == 0)) for p in (0, 1)}
    running = running.withColumns({f"_n{p}": F.sum(opens[p].cast("int")).over(order) for p in (0, 1)})
    placed = saved(running.drop("_out", "_in"), "csv-lines")

    ends = {f"{c}{p}": F.max_by(f"{c}{p}", "_id").alias(name + str(p)) for c, name in (("_end", "_e"), ("_n", "_records")) for p in (0, 1)}
    splits = placed.groupBy(*split).agg(*ends.values())
    by_file = Window.partitionBy("_source_file").orderBy("_block")
    blocks = _run(splits.withColumnsRenamed({"_e0": "_out", "_e1": "_in"}), by_file)
    blocks = blocks.withColumn("_open", F.coalesce(F.lag("_end0").over(by_file), F.lit(0)))
    own = F.when(F.col("_open") == 1, F.col("_records1")).otherwise(F.col("_records0"))
    earlier = F.coalesce(F.sum(own).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*split, "_open", earlier.alias("_earlier"))

    def chosen(name: str) -> Column:
        return F.when(F.col("_open") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    text = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    numbered = placed.join(blocks, split).select(
        "_source_file",
        (F.col("_earlier") + chosen("_n") - 1).alias("_row_num"),
        (chosen("_start") == 0).alias("_first"),
        (chosen("_end") == 0).alias("_last"),
        F.struct("_block", "_id", text.alias("value")).alias("_line"),
        "_blank",
    )
    data = numbered.filter((F.col("_row_num") > 0) & ~(F.col("_first") & F.col("_last") & F.col("_blank")))
    whole = data.filter("_first and _last").select("_source_file", "_row_num", F.col("_line.value").alias("record"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_line")), lambda x: x["value"]), "\n")
    several = data.filter("not (_first and _last)").groupBy("_source_file", "_row_num").agg(joined.alias("record"))
    records = whole.unionByName(several)
    return records.withColumn("record", F.regexp_replace("record", "\r$", ""))


def _run(rows: DataFrame, order: Window) -> DataFrame:
    """Adds _end0 and _end1: the state after each row for either state before the first row of its window.

    ``_out`` and ``_in`` are the row's own function: the state after it for either state before it. A row after which
    the state is the same either way fixes it; since then, or since the start, only swaps count.
    """
    swaps = F.sum((F.col("_out") > F.col("_in")).cast("int")).over(order)
    rows = rows.withColumn("_swaps", swaps % 2)
    fixed = F.when(F.col("_out") == F.col("_in"), F.col("_out").bitwiseXOR(F.col("_swaps").cast("int")))
    rows = rows.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(order))
    ends = {f"_end{p}": F.coalesce("_fixed", F.lit(p)).bitwiseXOR(F.col("_swaps").cast("int")) for p in (0, 1)}
    return rows.withColumns(ends).drop("_swaps", "_fixed")
