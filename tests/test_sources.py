import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sinks import zones as Z
from tidemark.sources import csv_files as C
from tidemark.sources import json_docs as J


def test_csv_layouts_encodings_and_row_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id; name \n1;  Zoë \n\n2;\n".encode())
    (tmp_path / "b.csv").write_bytes("id,name,extra\n3,caf\xe9,\"x, \"\"y\"\"\"\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("id\tname\n" .encode() + "".join(f"{i}\tn{i}\n" for i in range(100, 2100)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = C.scan_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    by_id = {r["id"]: r for r in got}
    assert len(got) == 2003
    assert by_id["1"]["name"] == "Zoë" and by_id["2"]["name"] is None and by_id["2"]["_row_num"] == 2
    assert by_id["3"]["name"] == "café" and by_id["3"]["extra"] == 'x, "y"'
    assert all(by_id[str(i)]["_row_num"] == i - 99 for i in range(100, 2100))
    assert by_id["3"]["_source_file"].endswith("/b.csv")


def test_typed_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d\n1,1,x,-2\n,2.5,3,4\n")
    df = C.scan_typed_csv(spark, str(tmp_path), ["a", "b", "c", "d"])
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "double"]


def test_typed_columns_follow_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    (tmp_path / "b.csv").write_text("b,a\ny,2\n")
    (tmp_path / "c.csv").write_text("a\n3\n")
    df = C.scan_typed_csv(spark, str(tmp_path), ["a", "b"])
    assert dict(df.dtypes) == {"a": "bigint", "b": "string"}
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (2, "y"), (3, None)]


def test_line_ends_inside_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"line one\nline two"\n2,z\n')
    (tmp_path / "b.csv").write_text("id,t\n3,plain\n")
    got = sorted((r["id"], r["t"], r["_row_num"]) for r in C.scan_csv(spark, str(tmp_path)).collect())
    assert got == [("1", "line one\nline two", 1), ("2", "z", 2), ("3", "plain", 1)]


def test_numbers_that_do_not_fit_are_reported(spark):
    from tidemark.sinks.zones import processed_records

    rows = spark.createDataFrame([(99999999999.5, 5, True, []), (1.0, 3_000_000_000, True, ["x"]), (2.0, 3, True, [])],
                                 "budget double, team_size long, _is_valid boolean, _validation_errors array<string>")
    got = [(r["valid"], r["rejected_reason"]) for r in processed_records(rows, F.lit("now")).collect()]
    assert got == [(False, "budget does not fit decimal(12,2)"), (False, "x; team_size does not fit int"), (True, None)]


def test_file_catalog(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"h\n1\n2\n")
    (tmp_path / "y.csv").write_bytes(b"h\n1")
    got = {r["path"][-5:]: r for r in C.file_catalog(spark, str(tmp_path)).collect()}
    for name, rows in (("x.csv", 2), ("y.csv", 1)):
        body = (tmp_path / name).read_bytes()
        assert (got[name]["sha256"], got[name]["estimated_rows"], got[name]["size_bytes"]) == (
            hashlib.sha256(body).hexdigest(), rows, len(body),
        )


def test_zone_inventory(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for i in range(12):
        (tmp_path / "raw" / f"f{i:02}.csv").write_bytes(b"x" * 1024)
    got = {r["zone"]: r for r in C.zone_inventory(spark, str(tmp_path), ["raw", "final"]).collect()}
    assert got["raw"]["file_count"] == 12 and got["raw"]["files"] == [f"f{i:02}.csv" for i in range(10)]
    assert got["raw"]["size_mb"] == pytest.approx(12 / 1024)
    assert (got["final"]["file_count"], got["final"]["files"], got["final"]["size_mb"]) == (0, [], 0.0)


def test_root_search(spark):
    docs = [
        {"data": 5, "results": [{"id": 1}]}, [{"id": 2}, {"id": 3}], {"items": [], "id": 4}, {"id": 5},
        {"data": [{"id": 6}], "results": [{"id": 7}]}, "text", 3,
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("{broken",)], "v string")
    assert sorted(r["id"] for r in J.search_roots(df, "v", "id: bigint").collect()) == [1, 2, 3, 4, 5, 6]


def test_envelopes(spark, tmp_path):
    for i, d in enumerate([{"data": [{"id": 1}, {"id": 2}]}, [{"id": 3}], {"data": []}, {"other": 1}, []]):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=2))
    (tmp_path / "9.json").write_text("")
    assert sorted(r["id"] for r in J.scan_envelopes(spark, str(tmp_path), "id: bigint").collect()) == [1, 2, 3]


def test_done_count_falls_back_to_rows(spark):
    df = spark.createDataFrame([("f", "b", "s", 0, 7), ("f", "b", "s", 3, 7), ("f", "b", "s", None, None)],
                               "file_id string, batch_id string, source string, count int, rows int")
    assert [r["count"] for r in Z.done_events(df, F.lit("t")).collect()] == [7, 3, None]


def test_upsert_keeps_id_and_last_row(spark):
    df = spark.createDataFrame([("p", "s", 1, "t1"), ("p", "s", 2, "t2"), ("q", "s", 3, "t1")],
                               "path string, sha256 string, rows int, ingested_at string")
    first = {r["path"]: r for r in Z.file_rows(df).collect()}
    again = {r["path"]: r for r in Z.file_rows(df.filter("rows <> 2")).collect()}
    assert first["p"]["rows"] == 2 and first["p"]["file_id"] == again["p"]["file_id"]


def test_one_layout_with_blank_first_line_and_line_ends_in_quotes(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('\n\nid,text\n1,"two\nlines"\n2,one\n')
    got = C.scan_csv(spark, str(tmp_path), multi_line=True).collect()
    assert sorted((r["id"], r["text"], r["_row_num"]) for r in got) == [("1", "two\nlines", 1), ("2", "one", 2)]


def test_layouts_in_files_with_blanks_in_their_names(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("id,x\n1,2\n")
    (tmp_path / "c+d.csv").write_text("id|y\n3|4\n")
    got = C.scan_csv(spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["x"], r["y"]) for r in got) == [("1", "2", None), ("3", None, "4")]
    assert C.file_catalog(spark, str(tmp_path)).count() == 2


def test_run_of_the_zones(spark, tmp_path):
    """Two files of different layout through all zones."""
    from tidemark.plans.flows import run_zones

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("dept,obj,prio,pct\n sales ,Grow fast,HIGH,150\n,ab,,x\n")
    (tmp_path / "in" / "b.csv").write_text("department;objective;team\nops;" + "word " * 500 + ";0\n")
    out = str(tmp_path / "out")
    totals = run_zones(spark, str(tmp_path / "in"), out, F.lit("now")).first()
    assert (totals["files"], totals["records"], totals["loaded"], totals["curated"]) == (2, 3, 3, 4)
    rows = {r["source_row_num"]: r for r in spark.read.parquet(f"{out}/processed/records_clean").filter("department is null or department = 'Sales'").collect()}
    assert (rows[1]["priority"], float(rows[1]["progress"]), rows[1]["valid"]) == ("High", 100.0, True)
    assert rows[2]["rejected_reason"] == "Invalid or too short objective" and rows[2]["priority"] == "Medium"
    docs = spark.read.parquet(f"{out}/curated/documents").collect()
    chunked = [json.loads(d["meta"]) for d in docs if json.loads(d["meta"])["is_chunked"]]
    assert sorted(m["chunk_index"] for m in chunked) == [0, 1] and chunked[0]["total_chunks"] == 2
    assert all(d["source"].rsplit("#")[-1] in ("1", "2") for d in docs)


def test_user_columns_with_the_names_of_row_metadata(spark, tmp_path):
    from tidemark.plans.flows import run_zones

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('row_num,file_id,source_file,objective\n7,f,s,"two\nlines"\n')
    out = str(tmp_path / "out")
    run_zones(spark, str(tmp_path / "in"), out, F.lit("now"))
    row = spark.read.parquet(f"{out}/processed/records_clean").first()
    payload = json.loads(row["original_payload"])
    assert {k: payload[k] for k in ("row_num", "file_id", "source_file")} == {"row_num": "7", "file_id": "f", "source_file": "s"}
    assert payload["objective"] == "two\nlines" and row["source_row_num"] == 1 and len(row["source_file_id"]) == 64
    meta = json.loads(spark.read.parquet(f"{out}/curated/documents").first()["meta"])
    assert meta["row_num"] == 1 and meta["source_file"].endswith("a.csv") and meta["original_fields"]["row_num"] == "7"


def test_workers_do_not_need_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    load = "import sys, pickle; pickle.loads(sys.stdin.buffer.read()); assert 'tidemark' not in sys.modules"
    sent = cloudpickle.dumps(C._file_hasher())
    subprocess.run([sys.executable, "-c", load], input=sent, cwd=tmp_path, check=True)
