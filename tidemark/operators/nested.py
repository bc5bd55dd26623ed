"""Nested documents to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.jsons import EXACT

# The fields of each nested object of an item.
STORE = [
    "id", "store_name", "location", "project_id", "store_keeper_id", "description",
    "is_permanent", "created_by", "updated_by", "is_deleted", "created_at", "updated_at",
]
UOM = [
    "id", "name", "is_countable", "created_by", "updated_by", "is_deleted", "description",
    "created_at", "updated_at",
]
CURRENCY = [
    "id", "name", "code", "symbol", "format", "exchange_rate", "active", "created_at",
    "updated_at", "is_offshore",
]
STATUS = [
    "id", "status_name", "created_by", "updated_by", "is_deleted", "description",
    "created_at", "updated_at",
]
TYPE = [
    "id", "inventory_type", "created_by", "updated_by", "is_deleted", "description",
    "created_at", "updated_at",
]
PROJECT = [
    "id", "project_name", "budget", "currency_id", "contract_sign_date", "client_id",
    "start_date", "lc_opening_date", "advance_payment_date", "end_date", "forex_resource",
    "isActive", "milestone_amount", "isDeleted", "system_id", "contract_payment",
    "forex_contract_payment", "forex_contract_payment_currency", "is_office", "created_by",
    "updated_by", "created_at", "updated_at", "plannedStart", "plannedFinish",
    "startVariance", "finishVariance", "actualStart", "actualFinish", "start", "finish",
    "duration", "actualDuration", "isOpportunity", "sector_id", "businessUnitId",
]

ASSET_LAYOUT = {"store": STORE, "uom": UOM, "currency": CURRENCY}
TOOL_LAYOUT = {"store": STORE, "status": STATUS, "uom": UOM, "currency": CURRENCY}
INVENTORY_LAYOUT = {
    "type": TYPE, "project": PROJECT, "store": STORE, "status": STATUS, "uom": UOM,
    "currency": CURRENCY,
}
# Nested objects that are left out whole.
ASSET_DROPPED = ["department", "manufacturer", "category", "asset_user"]
STOCK_DROPPED = ["department", "manufacturer", "category", "inventory_user"]


def member(df: DataFrame, obj: str, field: str) -> Column:
    """Field of a struct column, null where the column or the field is absent."""
    if obj in df.columns:
        kind = df.schema[obj].dataType
        if isinstance(kind, T.StructType) and field in kind.fieldNames():
            return F.col(f"`{obj}`.`{field}`")
    return F.lit(None).cast("string")


def flatten(df: DataFrame, layout: dict[str, list[str]], drop: list[str] = ()) -> DataFrame:
    """Scalars as they are, then ``object_field`` for every listed field."""
    skip = set(layout) | set(drop)
    scalars = [F.col(f"`{c}`") for c in df.columns if c not in skip]
    inner = [member(df, o, f).alias(f"{o}_{f}") for o, fields in layout.items() for f in fields]
    return df.select(*scalars, *inner)


def flatten_assets(df: DataFrame) -> DataFrame:
    return flatten(df.withColumn("is_fixed_asset", F.lit(1)), ASSET_LAYOUT, ASSET_DROPPED)


def flatten_tools(df: DataFrame) -> DataFrame:
    return flatten(df, TOOL_LAYOUT, STOCK_DROPPED)


def flatten_inventory(df: DataFrame) -> DataFrame:
    return flatten(df, INVENTORY_LAYOUT, STOCK_DROPPED)


# Columns of the endpoint-tagged wide table and their defaults.
TAGGED_COMMON = {
    "id": "", "item_name": "", "price": 0.0, "quantity": 0.0, "department_id": "",
    "date_of_purchased": "", "description": "",
}
TAGGED_NESTED = {
    "store_name": ("store", "store_name"),
    "store_location": ("store", "location"),
    "uom_name": ("uom", "name"),
    "status_name": ("status", "status_name"),
    "project_name": ("project", "project_name"),
    "inventory_type": ("type", "inventory_type"),
}
TAGGED_ONLY = {
    "requested_tools": {
        "requested_date": "", "requested_project_name": "", "requested_quantity": 0.0,
        "requester_id": "", "requester_name": "", "tool_id": "",
    },
    "approved": {
        "tool_id": "", "approved_date": "", "table": "", "is_approved": 0.0,
        "is_requester_received": 0.0, "is_returned": 0.0, "returned_quantity": 0.0,
    },
}


def _field(df: DataFrame, name: str, default) -> Column:
    """Column in the type of its default; the default stands in for an absent column."""
    kind = "string" if isinstance(default, str) else "double"
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(default)


def tag_endpoint(df: DataFrame, endpoint: str) -> DataFrame:
    """Flat row of one endpoint: common columns, nested names, its own columns."""
    out = [F.lit(endpoint).alias("endpoint_type")]
    out += [_field(df, n, d).alias(n) for n, d in TAGGED_COMMON.items()]
    out += [member(df, o, f).alias(n) for n, (o, f) in TAGGED_NESTED.items()]
    out += [_field(df, n, d).alias(n) for n, d in TAGGED_ONLY.get(endpoint, {}).items()]
    return df.select(*out)


def endpoint_flatten(endpoints: dict[str, DataFrame]) -> DataFrame:
    """All endpoints in one sparse wide table."""
    wide = None
    for name, df in endpoints.items():
        part = tag_endpoint(df, name)
        wide = part if wide is None else wide.unionByName(part, allowMissingColumns=True)
    return wide


def _fields(kind: T.DataType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}


def _first_set(parent: str, known: dict[str, T.DataType], names: list[str]) -> Column:
    """First key that is set and neither '' nor 0; else whatever the last key holds."""
    found = []
    for n in names:
        if n not in known:
            continue
        c = F.col(f"{parent}`{n}`")
        if n != names[-1]:
            unset = c == ("" if isinstance(known[n], T.StringType) else 0)
            c = F.when(~unset, c)
        found.append(c)
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _get(parent: str, known: dict[str, T.DataType], name: str) -> Column:
    return F.col(f"{parent}`{name}`") if name in known else F.lit(None).cast("string")


def _children(parent: str, known: dict[str, T.DataType], names: list[str]) -> Column:
    """First key that holds a list."""
    lists = [F.col(f"{parent}`{n}`") for n in names if isinstance(known.get(n), T.ArrayType)]
    return F.coalesce(*lists)


# The keys under which plans and tasks may keep their children.
TASK_KEYS = ["tasks", "weeklyTasks", "planTasks", "children"]
DAILY_KEYS = ["planTask", "planTasks", "dailyTasks", "children"]


def flatten_plans_inner(plans: DataFrame) -> DataFrame:
    """Plan, weekly task, daily task; tasks without daily tasks vanish. 10 columns."""
    top = _fields(plans.schema)
    tasks = plans.select(
        _first_set("", top, ["id", "weeklyPlanId"]).alias("weekly_plan_id"),
        _first_set("", top, ["description", "desc"]).alias("weekly_plan_desc"),
        F.explode(_children("", top, TASK_KEYS)).alias("t"),
    )
    task = _fields(tasks.schema["t"].dataType)
    daily = tasks.select(
        "weekly_plan_id",
        "weekly_plan_desc",
        _get("t.", task, "id").alias("weekly_task_id"),
        _first_set("t.", task, ["task", "name"]).alias("weekly_task_name"),
        _get("t.", task, "weight").alias("weekly_task_weight"),
        _get("t.", task, "priority").alias("weekly_task_priority"),
        F.explode(_children("t.", task, DAILY_KEYS)).alias("d"),
    )
    day = _fields(daily.schema["d"].dataType)
    return daily.select(
        *daily.columns[:-1],
        _get("d.", day, "id").alias("daily_task_id"),
        _first_set("d.", day, ["task", "name"]).alias("daily_task_name"),
        _get("d.", day, "weight").alias("daily_task_weight"),
        _get("d.", day, "priority").alias("daily_task_priority"),
    )


def flatten_plans_outer(plans: DataFrame, as_of: Column) -> DataFrame:
    """As the inner form with dates and status; a task without daily tasks keeps one row."""
    tasks = plans.select(
        F.col("id").alias("weekly_plan_id"),
        F.col("description").alias("weekly_plan_desc"),
        F.col("createdAt").alias("weekly_plan_created"),
        F.col("updatedAt").alias("weekly_plan_updated"),
        F.explode("tasks").alias("t"),
    )
    daily = tasks.select(
        *tasks.columns[:-1],
        F.col("t.id").alias("weekly_task_id"),
        F.col("t.task").alias("weekly_task_name"),
        F.col("t.weight").alias("weekly_task_weight"),
        F.col("t.priority").alias("weekly_task_priority"),
        F.col("t.status").alias("weekly_task_status"),
        F.explode_outer("t.planTask").alias("d"),
    )
    return daily.select(
        *daily.columns[:-1],
        F.col("d.id").alias("daily_task_id"),
        F.col("d.task").alias("daily_task_name"),
        F.col("d.weight").alias("daily_task_weight"),
        F.col("d.priority").alias("daily_task_priority"),
        F.col("d.status").alias("daily_task_status"),
        F.col("d.createdAt").alias("daily_task_created"),
        F.col("d.updatedAt").alias("daily_task_updated"),
        as_of.alias("extraction_timestamp"),
    )


def json_normalize(df: DataFrame) -> DataFrame:
    """Structs to dotted columns at any depth; arrays stay, as JSON text."""

    def walk(kind: T.StructType, path: str, name: str):
        for f in kind.fields:
            here, label = f"{path}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, here + ".", label + ".")
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                yield F.to_json(F.col(here), EXACT).alias(label)
            else:
                yield F.col(here).alias(label)

    return df.select(*walk(df.schema, "", ""))


def plan_counts(rows: DataFrame) -> DataFrame:
    """Distinct plans, weekly tasks and daily tasks, and all records."""
    return rows.agg(
        F.count_distinct("weekly_plan_id").alias("total_plans"),
        F.count_distinct("weekly_task_id").alias("total_weekly_tasks"),
        F.count_distinct("daily_task_id").alias("total_daily_tasks"),
        F.count(F.lit(1)).alias("total_records"),
    )


def recent(rows: DataFrame, newest: str, keys: list[str], columns: list[str], n: int = 20) -> DataFrame:
    """Newest ``n`` rows with the display columns that exist; keys break ties."""
    shown = [c for c in columns if c in rows.columns]
    order = [F.col(newest).desc_nulls_last()] + [F.col(k).asc_nulls_last() for k in keys]
    needed = list(dict.fromkeys([*shown, newest, *keys]))
    return rows.select(*needed).orderBy(*order).limit(n).select(*shown)
