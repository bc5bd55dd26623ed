"""Items of large JSON documents found in parallel, against Python's parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import json_docs as J
from tidemark.sources.json_records import depth_change, quotes, split_items

ITEM = "id: bigint, note: string, tags: array<string>, in: struct<a: bigint, b: array<struct<c: string>>>"


@pytest.fixture
def small_splits(spark):
    small = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "4096", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def items(seed, n):
    r = random.Random(seed)
    notes = ['plain', '}', '"', '\\', '\\"}', '{"data": [', '],}', 'é}\n', '\\\\', '"data": [{', "", "x" * 300]
    return [
        {
            "id": i,
            "note": "".join(r.choices(notes, k=r.randrange(4))),
            "tags": r.choices(notes, k=r.randrange(3)),
            "in": r.choice([None, {"a": i, "b": [{"c": r.choice(notes)} for _ in range(r.randrange(3))]}]),
        }
        for i in range(n)
    ]


def plain(rows):
    return sorted((r.asDict(recursive=True) for r in rows), key=lambda d: d["id"])


DOCUMENTS = {
    "list": lambda rows: json.dumps(rows),
    "lines": lambda rows: "\n" + json.dumps(rows, indent=1, ensure_ascii=False) + "\n",
    "envelope": lambda rows: json.dumps({"data": rows}),
    "more": lambda rows: json.dumps({"meta": {"data": [{"x": 1}], "s": '"data": ['}, "links": [{"id": 1}, {"id": 2}], "data": rows, "page": {"next": {"a": [{}]}}, "n": 3}, indent=2),
    "tail": lambda rows: json.dumps({"data": rows, "after": {"k": [{"id": -1}, {"id": -2}]}, "last": [1]}),
}


@pytest.mark.parametrize("shape", DOCUMENTS)
def test_split_documents(spark, tmp_path, small_splits, shape):
    rows = items(7, 600)
    (tmp_path / "a.json").write_text(DOCUMENTS[shape](rows), encoding="utf-8")
    found, others = split_items(spark, str(tmp_path), "data", 0)
    assert others.count() == 0
    got = found.orderBy("_item_num").collect()
    assert [r["_item_num"] for r in got] == list(range(600))
    assert [json.loads(r["item"]) for r in got] == rows
    assert plain(J.scan_envelopes(spark, str(tmp_path), ITEM, split_bytes=0).collect()) == rows


def test_one_document_is_read_by_several_tasks(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text(json.dumps(items(1, 1000)))
    pieces = spark.read.option("lineSep", "}").text(str(tmp_path))
    per_task = [r["count"] for r in pieces.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > 10
    assert max(per_task) < sum(per_task) / 5


ODD = [
    "", " ", "[]", '{"data": []}', '{"data": {}}', '{"data": null}', '{"id": 5}', "[1, 2]", '[{"id": 1}, null, {"id": 2}]', '[null]',
    '[{"id": 1}, 5]', '[{"id": 1} {"id": 2}]', '[{"id": 1}, {"id": 2}', '[{"id": 1}, {"id": 2', '{"data": [{"id": 1}]', '{"data": [{"id": 1}]}}',
    '{"data": [{"id": 1}], "data": [{"id": 2}]}', "[{'id': 1}, {'id': 2}]", '[{"id": "x"}, {"id": 2}]', '[{"id": 1, "id": 3}]', '[{"id": 1}]]',
    '[{"id": 1, "note": "\\}"}]', '[{"id": 1}, \\" {"id": 2}]', '{"DATA": [{"id": 1}]}', '[[{"id": 1}]]', '{"data": [[{"id": 1}], {"id": 2}]}',
    '[{"id": 1},, {"id": 2}]', '[{"id": 1},]', '[{"id": NaN}, {"id": 2}]', '{"data" : [ {"id": 1} , {"id": 2}\n] , "x": "}"}\n', '"data": [{"id": 1}]',
    '{"x": "\\\\", "data": [{"id": 1}]}', '{"x": {"y": {"z": 1}, "data": [{"id": 9}]}, "data": [{"id": 1}, {}]}', '[{}]', '[{"id": 1}] x',
]


def test_odd_documents_give_what_one_task_gives(spark, tmp_path):
    """Broken, empty and unusual documents: the same rows whether documents are split or not."""
    for i, text in enumerate(ODD):
        (tmp_path / f"{i}.json").write_text(text)
    schema = "id: bigint, note: string"
    for bare in (False, True):
        whole = J._parse_envelopes(spark.read.text(str(tmp_path), wholetext=True).select("value", "_metadata.file_name"), schema, bare)
        # by file, so that a difference names its document
        split = J.scan_envelopes(spark, str(tmp_path), schema, bare_object=bare, split_bytes=0)
        key = lambda r: (r["id"] is None, r["id"], r["note"] or "")
        assert sorted(whole.collect(), key=key) == sorted(split.collect(), key=key)


def test_small_and_large_files_together(spark, tmp_path, small_splits):
    rows = items(3, 300)
    (tmp_path / "a.json").write_text(json.dumps(rows[:5]))
    (tmp_path / "b.json").write_text(json.dumps({"data": rows[5:200]}))
    (tmp_path / "c.json").write_text(json.dumps(rows[200:], indent=1))
    assert plain(J.scan_envelopes(spark, str(tmp_path), ITEM, split_bytes=3000).collect()) == rows


def test_state_of_pieces(spark):
    """Quotes and depth of random pieces, character by character."""
    r = random.Random(2)
    texts = ["".join(r.choices('"\\[{],:a', k=r.randrange(14))) for _ in range(1500)]

    def walk(text, inside):
        count, depth, skip = 0, 0, False
        for c in text:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                inside, count = not inside, count + 1
            elif not inside:
                depth += (c in "[{") - (c in "]}")
        return count, depth

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", quotes(F.col("t")).alias("q"), *[depth_change(F.col("t"), s).alias(f"d{int(s)}") for s in (False, True)]).collect()
    for row in got:
        assert (row["q"], row["d0"]) == walk(row["t"], False), row
        assert row["d1"] == walk(row["t"], True)[1], row
