"""CSV scans and file catalogues."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import parse_double
from tidemark.functions.text import base_name, blank_to_null, strip
from tidemark.session import saved
from tidemark.sources.csv_records import csv_records, ends_inside

# Separators that are looked for, most likely first.
SEPARATORS = [",", ";", "\t", "|"]


def describe_files(spark: SparkSession, path: str) -> DataFrame:
    """Per file: encoding, separator, header line and whether quotes span lines; not those without text.

    One pass over the text: a file with any byte sequence that is not UTF-8 is
    read as ISO-8859-1 as a whole, and its separator is the most frequent
    candidate of its first line.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.struct(
            F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ).alias("at"),
    )
    ascii_blank = F.trim("value") == ""
    files = lines.groupBy("path").agg(
        F.when(F.bool_and(F.is_valid_utf8("value")), "UTF-8").otherwise("ISO-8859-1").alias("encoding"),
        F.min_by("value", F.when(~ascii_blank, F.col("at"))).alias("header"),
        # the first line that leaves a cell open is one that starts outside of cells
        *(F.bool_or(ends_inside(F.col("value"), s)).alias(f"open{i}") for i, s in enumerate(SEPARATORS)),
    )
    counts = [
        F.struct(
            (F.length("header") - F.length(F.replace("header", F.lit(s), F.lit("")))).alias("n"),
            F.lit(-i).alias("rank"),
            F.lit(s).alias("sep"),
            F.col(f"open{i}").alias("multi_line"),
        )
        for i, s in enumerate(SEPARATORS)
    ]
    files = files.filter(F.col("header").isNotNull())
    best = F.array_max(F.array(*counts))
    return files.select("path", "encoding", "header", best["sep"].alias("separator"), best["multi_line"].alias("multi_line"))


def _names(header: str, separator: str) -> list[str]:
    cells = next(csv.reader([header], delimiter=separator))
    return [c.strip().replace("﻿", "") for c in cells]


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _cells(
    spark: SparkSession, path: str | list[str], names: list[str], separator: str, encoding: str, multi_line: bool
) -> DataFrame:
    """The columns ``names``, _row_num and _source_file of CSV files of one layout; all files are split."""
    options = {"sep": separator, "quote": '"', "escape": '"'}
    if not multi_line:
        reader = spark.read.options(header=True, encoding=encoding, **options).schema(_text_schema(names))
        return _with_row_number(reader.csv(path), names)
    schema = ", ".join("`{}` STRING".format(n.replace("`", "``")) for n in names)
    cells = F.from_csv("record", schema, options)
    return csv_records(spark, path, separator, encoding).select(cells.alias("_cells"), "_row_num", "_source_file").select(
        "_cells.*", "_row_num", "_source_file"
    )


def _with_row_number(rows: DataFrame, names: list[str]) -> DataFrame:
    """Row number inside the file, from 1.

    Rows of one split have consecutive ids, so only the splits are counted and
    ordered; the rows themselves are neither shuffled nor sorted.
    """
    placed = rows.select(
        *[F.col(f"`{n}`") for n in names],
        F.col("_metadata.file_path").alias("_source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = placed.groupBy("_source_file", "_block").agg(
        F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy("_source_file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = splits.select(
        "_source_file",
        "_block",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low") + 1).alias("_shift"),
    )
    return (
        placed.join(starts, ["_source_file", "_block"])
        .withColumn("_row_num", F.col("_id") + F.col("_shift"))
        .select(*[F.col(f"`{n}`") for n in names], "_row_num", "_source_file")
    )


def scan_layout(
    spark: SparkSession,
    path: str | list[str],
    names: list[str],
    separator: str = ",",
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> DataFrame:
    """CSV files of one known layout as trimmed text columns, without a look at them first."""
    return _cells(spark, path, names, separator, encoding, multi_line).withColumns(
        {n: blank_to_null(strip(F.col(f"`{n}`"))) for n in names}
    )


def _layouts(spark: SparkSession, path: str) -> list[tuple[list[str], str, str, bool, str | list[str]]]:
    """(names, separator, encoding, multi_line, what to read) of each layout below ``path``.

    The files are described once. Where all share a layout the path is read as it is; else the driver
    holds the list of files, as it does for any scan.
    """
    key = ["encoding", "separator", "header", "multi_line"]
    files = saved(describe_files(spark, path), "csv-files")
    layouts = files.select(*key).distinct().orderBy("header", "separator", "encoding", "multi_line").collect()
    if not layouts:
        raise FileNotFoundError(f"no CSV lines below {path}")
    found: dict[tuple, list[str]] = {}
    if len(layouts) > 1:
        for row in files.toLocalIterator():
            found.setdefault(tuple(row[k] for k in key), []).append(unquote(row["path"]))
    return [
        (_names(x["header"], x["separator"]), x["separator"], x["encoding"], x["multi_line"], found.get(tuple(x), path))
        for x in layouts
    ]


def scan_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """All CSV files below ``path`` as trimmed text columns, whatever their layout.

    Files are grouped by (encoding, separator, header); each group is one scan. All files are split, also
    those with line ends inside quotes, which are found; ``multi_line`` sets it for all.
    """
    parts = [
        scan_layout(spark, read, names, separator, encoding, spans if multi_line is None else multi_line)
        for names, separator, encoding, spans, read in _layouts(spark, path)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$") & c.try_cast("bigint").isNotNull()


def scan_typed_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Columns ``names`` of CSV files; each column gets the narrowest type all its cells fit.

    Cells are taken by the header of their file; a file without a column has nulls there. Digits are whole
    numbers, other number texts are doubles, the empty text is null.
    """
    parts = []
    for own, separator, encoding, spans, read in _layouts(spark, path):
        rows = _cells(spark, read, own, separator, encoding, spans)
        cells = [F.col(f"`{n}`") if n in own else F.lit(None).cast("string") for n in names]
        parts.append(rows.select(*[blank_to_null(c).alias(n) for c, n in zip(cells, names)]))
    raw = reduce(DataFrame.unionByName, parts)
    checks = []
    for n in names:
        c = F.col(f"`{n}`")
        number = _digits(c) | parse_double(c).isNotNull()
        # empty cells have no say
        checks.append(F.bool_and(F.when(c.isNotNull(), _digits(c))).alias(f"{n}|whole"))
        checks.append(F.bool_and(F.when(c.isNotNull(), number)).alias(f"{n}|number"))
    found = raw.agg(*checks).first()
    out = []
    for n in names:
        c = F.col(f"`{n}`")
        if found[f"{n}|whole"]:
            c = c.cast("bigint")
        elif found[f"{n}|number"]:
            c = parse_double(c)
        out.append(c.alias(n))
    return raw.select(*out)


def _file_hasher():
    """SHA-256 and line count of each file, read as a stream of blocks.

    A local function: it is sent to the workers by value, so they need pyarrow
    and pandas but not this package.
    """

    def hash_files(batches):
        import hashlib

        import pandas
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path, size in zip(batch["path"], batch["size_bytes"]):
                system, inner = fs.FileSystem.from_uri(path)
                digest, lines, last = hashlib.sha256(), 0, b"\n"
                with system.open_input_stream(inner, buffer_size=1 << 22) as source:
                    while block := source.read(1 << 22):
                        digest.update(block)
                        lines += block.count(b"\n")
                        last = block[-1:]
                rows.append((path, digest.hexdigest(), lines + (last != b"\n") - 1, size))
            yield pandas.DataFrame(rows, columns=["path", "sha256", "estimated_rows", "size_bytes"])

    return hash_files


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and size of files; the content is not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size_bytes"))
    )


def file_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Path, SHA-256, row count without the header, size; files of any size."""
    return list_files(spark, path).repartition("path").mapInPandas(
        _file_hasher(), "path string, sha256 string, estimated_rows bigint, size_bytes bigint"
    )


def zone_inventory(spark: SparkSession, root: str, zones: list[str], shown: int = 10) -> DataFrame:
    """Per zone folder: file count, total MB, first names; a missing zone has zero files."""
    inner = F.substring_index(F.col("path"), urlparse(root).path.rstrip("/") + "/", -1)
    files = (
        list_files(spark, root)
        .withColumn("_inner", inner)
        .filter(F.size(F.split("_inner", "/")) == 2)
        .select(
            F.substring_index("_inner", "/", 1).alias("zone"),
            base_name(F.col("path")).alias("name"),
            "size_bytes",
        )
    )
    first = Window.partitionBy("zone").orderBy("name")
    names = (
        files.withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= shown)
        .groupBy("zone")
        .agg(F.array_sort(F.collect_list("name")).alias("files"))
    )
    sizes = files.groupBy("zone").agg(
        F.count(F.lit(1)).alias("file_count"),
        (F.sum("size_bytes") / (1024 * 1024)).alias("size_mb"),
    )
    wanted = spark.createDataFrame([(z,) for z in zones], "zone string")
    return (
        wanted.join(sizes, "zone", "left")
        .join(names, "zone", "left")
        .select(
            "zone",
            F.coalesce("file_count", F.lit(0)).alias("file_count"),
            F.coalesce("files", F.array().cast("array<string>")).alias("files"),
            F.coalesce("size_mb", F.lit(0.0)).alias("size_mb"),
        )
    )
