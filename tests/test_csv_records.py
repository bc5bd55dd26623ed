"""CSV records found in parallel, against Python's reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import csv_files as C
from tidemark.sources.csv_records import csv_records, ends_inside


def python_rows(text, separator):
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=separator) if any(c.strip() for c in r)]


def inside_after(text, separator, inside):
    """The state after a line, character by character."""
    state = "in" if inside else "start"
    for c in text:
        if state == "in":
            state = "quote" if c == '"' else "in"
        elif state == "quote" and c == '"':
            state = "in"
        elif c == separator:
            state = "start"
        elif c == '"' and state == "start":
            state = "in"
        else:
            state = "middle"
    return state == "in"


def test_states_of_lines(spark):
    r = random.Random(1)
    lines = ["".join(r.choices('",ab ', k=r.randrange(12))) for _ in range(1500)]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    for sep in ",;":
        got = df.select("value", ends_inside(F.col("value"), sep).alias("o"), ends_inside(F.col("value"), sep, True).alias("i")).collect()
        for row in got:
            assert (row["o"], row["i"]) == (inside_after(row["value"], sep, False), inside_after(row["value"], sep, True)), row


def table(seed, n, sep=",", end="\n"):
    """Rows with line ends, quotes, separators and stray quotes in their cells."""
    r = random.Random(seed)
    lines = [f"id{sep}note{sep}last"]
    for i in range(n):
        note = r.choice(["plain", '5" pipe', 'ends 5"', '"two\nlines"', '"a\n\nb ""q"" c"', '""', '"x,;y"', "", '"""\n"""', '"\n"'])
        note = note.replace(sep, "-") if note[:1] != '"' else note
        lines.append(f"{i}{sep}{note}{sep}{r.choice(['z', '', chr(34) + 'k' + sep + chr(10) + chr(34)])}")
        if r.random() < 0.1:
            lines.append(r.choice(["", "  "]))
    return end.join(lines) + r.choice(["", end])


@pytest.fixture
def small_splits(spark):
    small = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "4096", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in small}
    for n, v in small.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("sep,end", [(",", "\n"), (";", "\n"), ("\t", "\r\n")])
def test_records_equal_pythons_reader(spark, tmp_path, small_splits, sep, end):
    texts = {f"f{k}.csv": table(k, 1200, sep, end) for k in range(2)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    assert C.describe_files(spark, str(tmp_path)).filter("multi_line").count() == 2
    got = C.scan_csv(spark, str(tmp_path)).collect()
    for name, text in texts.items():
        want = [[c.strip() or None for c in r] for r in python_rows(text, sep)[1:]]
        mine = sorted((r for r in got if r["_source_file"].endswith(name)), key=lambda r: r["_row_num"])
        assert [r["_row_num"] for r in mine] == list(range(1, len(want) + 1))
        assert [[r["id"], r["note"], r["last"]] for r in mine] == [(r + [None] * 3)[:3] for r in want]


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    text = 'id,x\n1,"two\nlines"\n' + "".join(f"{i},y{i}\n" for i in range(2, 20_000))
    (tmp_path / "a.csv").write_text(text)
    records = csv_records(spark, str(tmp_path), ",", "UTF-8")
    counts = [r["n"] for r in records.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(counts) > 4 and max(counts) < 0.5 * 20_000
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 8


def test_a_cell_over_many_splits_and_one_never_closed(spark, tmp_path, small_splits):
    cell = "\n".join(f'line {i} ""q"", x' for i in range(3000))
    (tmp_path / "a.csv").write_text(f'id,x\n1,"{cell}"\n2,b\n3,"open\nto the end\n')
    got = {r["id"]: r["x"] for r in C.scan_csv(spark, str(tmp_path)).collect()}
    assert got["1"] == cell.replace('""', '"') and got["2"] == "b" and set(got) == {"1", "2", "3"}


def test_latin_files_and_typed_columns_with_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,x,n\n1,"gr\nün",5\n2,é,6\n'.encode("latin-1"))
    got = C.scan_typed_csv(spark, str(tmp_path), ["n", "x", "id"])
    assert got.dtypes == [("n", "bigint"), ("x", "string"), ("id", "bigint")]
    assert sorted(map(tuple, got.collect())) == [(5, "gr\nün", 1), (6, "é", 2)]
