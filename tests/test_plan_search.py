"""The search for plans under a root key reads each document and each record once."""

import json

from pyspark.sql import functions as F

from tidemark.operators import nested as N
from tidemark.plans.flows import PLAN_ITEM
from tidemark.plans.nesting import nested_plans
from tidemark.sinks import messages as M
from tidemark.sources import json_docs as J

PLAN = {"id": 1, "description": "p", "tasks": [{"id": 10, "task": "w", "planTask": [{"id": 100, "task": "d", "weight": 1.5}]}]}
RECORD = "id: BIGINT, name: STRING, weight: DOUBLE, tasks: array<struct<id: BIGINT, task: STRING>>"


def test_records_are_read_once(spark):
    docs = spark.createDataFrame([(json.dumps({"weeklyPlans": [PLAN]}),)], "value string")
    flat = N.flatten_plans_inner(J.search_roots(docs, "value", PLAN_ITEM))
    lines = flat._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # no filter reads records, no list of variants is copied, and each path is read in one place
    assert not [line for line in lines if "Filter" in line and "try_variant_get" in line]
    text = "\n".join(lines)
    assert "ArrayType(VariantType" not in text
    assert [text.count(f"$.{k},") for k in J.ROOT_KEYS] == [1] * len(J.ROOT_KEYS)
    assert text.count("parseJson") == 1
    assert [tuple(r)[0] for r in flat.collect()] == [1]


def test_odd_documents(spark):
    """As the records of a list of variants, each read by itself."""
    odd = [
        {"id": "7", "name": {"b": 1, "a": [1.50, None]}, "weight": "2.5"}, {"id": 2.9, "name": 5, "weight": 3}, {"id": "x", "name": True},
        {"id": 2**70, "weight": 1e300}, {"id": None, "tasks": [{"id": 1, "task": "é\n"}, None, 4, {"more": 1}]}, {"tasks": {}}, {}, None, 3, "s", [1], [{"id": 1}],
    ]
    docs = [json.dumps({k: odd}) for k in J.ROOT_KEYS] + [json.dumps(odd), " " + json.dumps(odd), "\n" + json.dumps({"data": odd})]
    docs += [json.dumps(d) for d in odd] + [json.dumps({"data": d, "plans": [{"id": 9}]}) for d in odd]
    docs += [json.dumps({"data": [], "id": 8}), json.dumps({"tasks": [{"id": 3, "task": "t"}], "id": 8}), "[]", "[[]]", "{}", "", " ", "{", '{"id": 1, "id": 2}', '{"data": [{"id": 1, "id": 2}]}', "{'id': 1}", '{"id": -0.0, "weight": -0.0}', '\n{"id": 4}', "null", None]
    rows = spark.createDataFrame([(d,) for d in docs], "value string")
    parsed = rows.select("value", F.try_parse_json("value").alias("d"))
    whole, *lists = [F.try_variant_get("d", p, "array<variant>") for p in ["$", *(f"$.{k}" for k in J.ROOT_KEYS)]]
    found = F.coalesce(*lists)
    braced = F.ltrim("value").startswith("{") & F.col("d").isNotNull()
    each = F.when(whole.isNotNull(), whole).when(F.size(found) > 0, found).when(braced, F.array("d"))
    read = parsed.select(F.explode_outer(each).alias("v")).select(F.try_variant_get("v", "$", f"struct<{RECORD}>").alias("r"))
    want = sorted(map(str, read.filter(F.col("r").isNotNull()).select("r.*").collect()))
    assert len(want) > 50
    assert sorted(map(str, J.search_roots(rows, "value", RECORD).collect())) == want


def test_documents_of_odd_keys(spark):
    """Keys that repeat, are null or have no partner; the texts of a line are made before lines are grouped."""
    customers = [(1, "a"), (1, "b"), (2, None), (None, "n"), (3, "idle")]
    orders = [(10, 1, 1.5, "H", "F"), (10, 2, None, "L", None), (11, 1, 2.0, None, "O"), (None, 2, 3.0, "H", "F"), (12, None, 4.0, "H", "F"), (13, 9, 5.0, "H", "F")]
    lines = [(10, 1, 5, 1.0, "R", "F", "2001-01-05 00:00:00"), (10, 2, None, 2.0, None, "O", "2001-01-06 10:00:00.25"), (10, 2, 7, None, "A", None, "2001-02-01 00:00:00"), (10, 3, 8, 3.0, "A", "F", None), (None, 4, 9, 4.0, "A", "F", "2001-01-05 00:00:00"), (14, 1, 1, 1.0, "R", "F", "2001-01-05 00:00:00")]
    customer = spark.createDataFrame(customers, "c_custkey bigint, c_name string")
    order = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string, o_orderstatus string")
    line = spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, l_returnflag string, l_linestatus string, s string")
    plans = nested_plans(customer, order, line.withColumn("l_shipdate", F.col("s").cast("timestamp_ntz")))

    def iso(s):
        return None if s is None else s.replace(" ", "T") + ("0000" if "." in s else "")

    want = []
    for key, name in customers:
        mine = [o for o in orders if key is not None and o[1] == key]
        for o in mine:
            own = [x for x in lines if o[0] is not None and x[0] == o[0]]
            for month in {(x[6] or "")[:7] for x in own} or {None}:
                daily = [x for x in own if (x[6] or "")[:7] == month]
                daily = [(x[0] * 10 + x[1], None if x[2] is None else f"part {x[2]}", x[3], x[4], x[5], iso(x[6]), iso(x[6])) for x in daily]
                want.append((key, name, [(o[0], None if o[0] is None else f"order {o[0]}", *o[2:], sorted(daily, key=str))]))
        if not mine:
            want.append((key, name, []))
    got = [(r["id"], r["description"], [(*t[:5], sorted(map(tuple, t["planTask"]), key=str)) for t in r["tasks"]]) for r in plans.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    grouped = [x for x in plans._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in x]
    assert grouped and not [x for x in grouped if "date_format" in x]


def test_iso_text(spark):
    from tidemark.functions.times import iso_text

    texts = ["2001-02-03 04:05:06", "2001-02-03 04:05:06.5", "2001-02-03 04:05:06.000001", "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999", "2001-02-03 00:00:00", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = ["2001-02-03T04:05:06", "2001-02-03T04:05:06.500000", "2001-02-03T04:05:06.000001", "0001-01-01T00:00:00", "9999-12-31T23:59:59.999999", "2001-02-03T00:00:00", None]
    for kind in ("timestamp", "timestamp_ntz"):
        once = df.select(iso_text(F.col("t").cast(kind)).alias("x"))
        assert [r["x"] for r in once.collect()] == want
        assert once._jdf.queryExecution().optimizedPlan().toString().count("date_format") <= 1


def test_quick_packing(spark, tmp_path):
    rows = spark.range(20000).select(F.concat(F.lit('{"id":'), F.col("id"), F.lit(',"task":"t"}')).alias("value")).coalesce(1)
    kept = {}
    for name, options in (("packed", M.PACKED), ("quick", M.QUICK)):
        M.write_table(rows, f"{tmp_path}/{name}", "json", **options)
        assert spark.read.schema("value string").json(f"{tmp_path}/{name}").exceptAll(rows).isEmpty()
        kept[name] = sum(f.stat().st_size for f in (tmp_path / name).glob("part-*"))
    assert kept["packed"] < kept["quick"] < 2 * kept["packed"]
