"""Stock: items, requests, approvals and what is left of each item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import hot_keys, left_join
from tidemark.session import saved

# Columns of the cleaned tables.
ITEM_COLUMNS = [
    "id", "item_name", "price", "amount", "is_consumable", "is_fixed_asset", "department_id",
    "date_of_purchased", "description", "po_id", "store_store_name", "uom_name", "quantity",
]
REQUESTED_TOOL_COLUMNS = [
    "id", "item_name", "requested_date", "requested_project_name", "requested_quantity",
    "requester_id", "requester_name", "requester_received_date", "status_name", "store_name",
    "tool_id", "uom_name",
]
REQUESTED_INVENTORY_COLUMNS = [
    "id", "item_name", "requested_date", "requested_project_name", "requested_quantity",
    "requester_id", "requester_name", "store_name", "tool_id", "uom_name",
]
INVENTORY_RENAMES = {"requester_name": "name", "tool_id": "inventory_id"}
APPROVED_COLUMNS = [
    "id", "tool_id", "approved_date", "table", "is_approved", "is_requester_received",
    "is_returned", "returned_quantity",
]
APPROVAL_ADDED = {
    "approved_date": "string", "is_approved": "int", "is_requester_received": "int",
    "is_returned": "int", "returned_quantity": "double",
}


def clean_items(items: DataFrame, as_of: Column, keep: list[str] = ITEM_COLUMNS) -> DataFrame:
    """Wanted columns (absent ones null); rows with neither department nor quantity go."""

    def pick(name: str) -> Column:
        if name not in items.columns:
            return F.lit(None).cast("string").alias(name)
        return (F.col(name).cast("string") if name == "id" else F.col(name)).alias(name)

    return (
        items.select(*[pick(c) for c in keep])
        .dropna(how="all", subset=["department_id", "quantity"])
        .withColumn("last_updated", as_of)
    )


def _pick_or_empty(df: DataFrame, source: str, name: str) -> Column:
    if source not in df.columns:
        return F.lit("").alias(name)
    c = F.col(source)
    # the id columns are printed, and a printed null reads None
    return (F.coalesce(c.cast("string"), F.lit("None")) if name in ("id", "tool_id") else c).alias(name)


def requested_tools(requests: DataFrame) -> DataFrame:
    """The 12 request columns; a column the source lacks is the empty text."""
    return requests.select(*[_pick_or_empty(requests, c, c) for c in REQUESTED_TOOL_COLUMNS])


def requested_inventory(requests: DataFrame) -> DataFrame:
    """The 10 request columns, two of them under the inventory names."""
    return requests.select(
        *[_pick_or_empty(requests, INVENTORY_RENAMES.get(c, c), c) for c in REQUESTED_INVENTORY_COLUMNS]
    )


def approved_only(approvals: DataFrame) -> DataFrame:
    """Rows that carry an approval date, 8 columns."""
    date = F.col("approved_date")
    return approvals.filter(date.isNotNull() & (date.cast("string") != "")).select(
        *[_pick_or_empty(approvals, c, c) for c in APPROVED_COLUMNS]
    )


def drop_incomplete(df: DataFrame, required: list[str]) -> DataFrame:
    return df.dropna(how="any", subset=required)


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Tag every part with its name, drop leftover columns, union by column name."""
    tagged = [
        df.drop("storekeeper_received_date", "tool_type").withColumn("source", F.lit(name))
        for name, df in parts.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def combined_requests(tools: DataFrame, inventory: DataFrame, as_of: Column) -> DataFrame:
    """Complete requests of both sources, full-row duplicates dropped, stamped."""
    need = ["requested_project_name", "requested_quantity"]
    return (
        union_sources({"tools": drop_incomplete(tools, need), "inventory": drop_incomplete(inventory, need)})
        .dropDuplicates()
        .withColumn("last_updated", as_of)
    )


def combined_items(parts: dict[str, DataFrame]) -> DataFrame:
    """Complete items of all sources, full-row duplicates dropped."""
    need = ["quantity", "department_id"]
    return union_sources({n: drop_incomplete(df, need) for n, df in parts.items()}).dropDuplicates()


def _key(c: str) -> Column:
    # a null key prints as "nan" and so matches another null key
    return F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c)


def with_approvals(requests: DataFrame, approvals: DataFrame | None) -> DataFrame:
    """Requests with the five approval columns on (id, tool_id); repeats fan out.

    Without approvals the columns are null. A key that is hot on either side is split on both.
    """
    if approvals is None:
        return requests.withColumns(
            {n: F.lit(None).cast(kind) for n, kind in APPROVAL_ADDED.items()}
        )
    left = requests.withColumns({"id": _key("id"), "tool_id": _key("tool_id")})
    right = approvals.select(_key("id"), _key("tool_id"), *APPROVAL_ADDED)
    keys = ["id", "tool_id"]
    return left_join(left, right, keys, hot_keys([left, right], keys))


def fulfilled(joined: DataFrame) -> DataFrame:
    """Received quantity per (tool_id, id) of the requests with their approvals."""
    return (
        joined.filter(F.col("is_requester_received") == 1)
        .groupBy("tool_id", "id")
        .agg(F.coalesce(F.sum("requested_quantity"), F.lit(0.0)).alias("requested_quantity"))
    )


def fulfilled_from(requests: DataFrame, approvals: DataFrame) -> DataFrame:
    """Same rows as ``fulfilled(with_approvals(...))`` without the row-level join.

    Each side is summed per key before the shuffle, so one row per key meets
    one row per key however many rows a hot key has.
    """
    wanted = (
        requests.select(_key("id"), _key("tool_id"), "requested_quantity")
        .groupBy("tool_id", "id")
        .agg(F.coalesce(F.sum("requested_quantity"), F.lit(0.0)).alias("_q"))
    )
    received = (
        approvals.filter(F.col("is_requester_received") == 1)
        .select(_key("id"), _key("tool_id"))
        .groupBy("tool_id", "id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return wanted.join(received, ["tool_id", "id"]).select(
        "tool_id", "id", (F.col("_q") * F.col("_n")).alias("requested_quantity")
    )


def returned(approvals: DataFrame) -> DataFrame:
    """Returned quantity per (tool_id, id)."""
    return (
        approvals.filter(F.col("is_returned") == 1)
        .select(_key("tool_id"), _key("id"), "returned_quantity")
        .groupBy("tool_id", "id")
        .agg(F.coalesce(F.sum("returned_quantity"), F.lit(0.0)).alias("returned_quantity"))
    )


def _stock(items: DataFrame) -> DataFrame:
    return items.withColumn(
        "current_stock",
        F.col("quantity")
        - F.coalesce("requested_quantity", F.lit(0.0))
        + F.coalesce("returned_quantity", F.lit(0.0)),
    ).drop("requested_quantity", "returned_quantity")


def current_stock(items: DataFrame, sums: DataFrame | None, back: DataFrame | None) -> DataFrame:
    """Stock with sums per (tool_id, id) joined on the request id alone.

    One output row per matching pair of sums, as the defined result has it; use
    ``current_stock_by_item`` for one row per item. A request id that is hot on any of the three sides is
    split on both sides of each join.
    """
    if sums is None or back is None:
        return items.withColumn("current_stock", F.col("quantity"))
    sums, back = saved(sums.drop("tool_id"), "received"), saved(back.drop("tool_id"), "returned")
    hot = hot_keys([items, sums, back], ["id"])
    taken = left_join(items, sums, ["id"], hot, ((0,), 1))
    return _stock(left_join(taken, back, ["id"], hot, ((0, 1), 2)))


def current_stock_by_item(items: DataFrame, sums: DataFrame, back: DataFrame) -> DataFrame:
    """Stock with sums per tool, joined on the item: one row per item."""
    out = sums.groupBy(F.col("tool_id").alias("id")).agg(
        F.sum("requested_quantity").alias("requested_quantity")
    )
    home = back.groupBy(F.col("tool_id").alias("id")).agg(
        F.sum("returned_quantity").alias("returned_quantity")
    )
    return _stock(items.join(out, "id", "left").join(home, "id", "left"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key is set but has no parent row."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def approval_counts(requests: DataFrame, approvals: DataFrame) -> DataFrame:
    """How many rows ``with_approvals`` has per (is_approved, is_requester_received).

    Counts per key meet counts per key, so the rows of a hot key are never paired.
    """
    keys = ["id", "tool_id"]
    asked = requests.groupBy(_key("id"), _key("tool_id")).agg(F.count(F.lit(1)).alias("_m"))
    decided = approvals.groupBy(
        _key("id"), _key("tool_id"), "is_approved", "is_requester_received"
    ).agg(F.count(F.lit(1)).alias("_n"))
    return (
        asked.join(decided, keys, "left")
        .groupBy("is_approved", "is_requester_received")
        .agg(F.sum(F.col("_m") * F.coalesce("_n", F.lit(1))).alias("n"))
    )


def request_kpis(counts: DataFrame) -> DataFrame:
    """Total, pending, approved and fulfilled requests from ``approval_counts``."""
    approved = F.col("is_approved")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return counts.agg(
        total(F.lit(True)).alias("total_requests"),
        total(approved.isNull() | (approved == 0)).alias("pending_requests"),
        total(approved == 1).alias("approved_requests"),
        total(F.col("is_requester_received") == 1).alias("fulfilled_requests"),
    )


def inventory_kpis(stock: DataFrame, low: float = 10) -> DataFrame:
    level = "current_stock" if "current_stock" in stock.columns else "quantity"
    few = F.count_if(F.col(level) < low) if level == "current_stock" else F.lit(0).cast("bigint")
    return stock.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.coalesce(F.sum(level), F.lit(0.0)).alias("total_stock"),
        few.alias("low_stock_items"),
        F.coalesce(F.sum(F.col("price") * F.col("quantity")), F.lit(0.0)).alias("total_value"),
    )


def stock_by_source(stock: DataFrame) -> DataFrame:
    level = "current_stock" if "current_stock" in stock.columns else "quantity"
    return (
        stock.filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.coalesce(F.sum(level), F.lit(0.0)).alias("stock"))
    )


def top_departments(items: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` departments with the most items; the name breaks ties."""
    return (
        items.filter(F.col("department_id").isNotNull())
        .groupBy("department_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "department_id")
        .limit(n)
    )


def request_status(counts: DataFrame) -> DataFrame:
    """Requests per status from ``approval_counts``; undecided and refused are pending."""
    approved = F.col("is_approved")
    status = F.when(approved.isNull() | (approved == 0), "Pending").when(approved == 1, "Approved")
    return counts.groupBy(status.alias("status")).agg(F.sum("n").alias("n"))


def daily_requests(requests: DataFrame) -> DataFrame:
    """Requests per day; a date that cannot be read is left out."""
    date = F.col("requested_date")
    if dict(requests.dtypes)["requested_date"] == "string":
        date = F.try_to_timestamp(date)
    return (
        requests.select(F.to_date(date).alias("day"))
        .filter(F.col("day").isNotNull())
        .groupBy("day")
        .agg(F.count(F.lit(1)).alias("n"))
    )
