"""Benchmark decontamination by winnowing.

Words are hashed, runs of k words are hashed, and of each window of w runs in a row the smallest hash
is kept: so any span of t = k + w - 1 words that a document shares with a benchmark item has a
kept hash in both. Kept hashes are joined; where one meets, the shared stretch is extended to
windows of t words, which are compared word by word. Neighbouring windows mostly keep the same
hash and travel as one row.

Items with fewer than t words are a window of their own length; each length that occurs is
winnowed with a span of that length.

The benchmark side is broadcast only if it was counted and is small; else both sides are
shuffled by hash, where Spark splits what is frequent. A document's words never leave it except for
windows that meet a kept hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import saved

#: Words are a-z, digits and everything beyond ASCII; what stands between them:
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 10
RUN = 5
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _shifted(df: DataFrame, source: str, by: int, name: str, join) -> DataFrame:
    """Add ``name``: element i of ``source`` joined with element i + ``by``, where there is one."""
    n = F.greatest(F.size(source) - by, F.lit(0))
    return df.withColumn(name, F.zip_with(F.slice(source, F.lit(1), n), F.slice(source, F.lit(by + 1), n), join))


def _over(df: DataFrame, source: str, width: int, name: str, join) -> DataFrame:
    """Add ``name``: ``join`` over each ``width`` elements in a row, by doubling."""
    if width == 1:
        return df.withColumn(name, F.col(source))
    have, at = 1, source
    while have < width:
        step = min(have, width - have)
        have += step
        out = name if have == width else f"{name}_{have}"
        df = _shifted(df, at, step, out, join)
        at = out
    return df


def kept_hashes(df: DataFrame, keys: list[str], span: int, run: int = RUN) -> DataFrame:
    """(keys..., span, hash, start, windows) of ``df`` (keys..., words).

    For each run of windows in a row that keep the same hash: the hash, where the first window starts
    and how many there are. Rows with fewer than ``span`` words have none.
    """
    k = min(run, span)
    df = df.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("_h"))
    # two overlapping halves make a run's hash depend on all its words, and on their order
    df = _over(df, "_h", k, "_g", lambda a, b: F.xxhash64(a, b))
    df = _over(df, "_g", span - k + 1, "_m", lambda a, b: F.least(a, b))
    changes = F.filter(
        F.sequence(F.lit(0), F.size("_m") - 1), lambda i: (i == 0) | (F.get("_m", i) != F.get("_m", i - 1))
    )
    df = df.select(*keys, "_m", F.when(F.size("_m") > 0, changes).alias("_at"))
    rows = F.transform(
        "_at",
        lambda i, x: F.struct(
            F.get("_m", i).alias("hash"), i.alias("start"), (F.coalesce(F.get("_at", x + 1), F.size("_m")) - i).alias("windows")
        ),
    )
    return (
        df.select(*keys, rows.alias("_rows"))
        .select(*keys, F.explode_outer("_rows").alias("_r"))
        .filter("_r is not null")
        .select(*keys, F.lit(span).alias("span"), "_r.hash", "_r.start", "_r.windows")
    )


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


NEW = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    ``docs`` has doc_id and text, ``benchmark`` has item_id and text; all columns of ``docs`` are kept as they are,
    whatever their names, except that those of the new names are replaced. A window is ``span`` item words in a row; an item with fewer words,
    but not none, is one window. A document word inside any occurrence of a window is hit. n_items
    counts the items with occurring windows; items_sha256 is the SHA-256 of their ids, sorted as text
    and joined by commas (of the empty text if there are none). Null texts have no words. Items
    with a null id hit words but are not listed; items that repeat are listed once. A row is known by
    its id and text, so repeated rows get the same result each.
    """
    found = _found(docs, benchmark, span)
    return found.select(*(F.col("_user")[c].alias(c) for c in docs.columns if c not in NEW), *NEW)


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` without a word in a window of an item; columns stay as they are."""
    return _found(docs, benchmark, span).filter("not contaminated").select("_user.*")


def _found(docs: DataFrame, benchmark: DataFrame, span: int) -> DataFrame:
    """The columns of ``docs`` as one, ``_user``, beside the new ones; so no name of a user can clash."""
    id_of = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(id_of.alias("_id"), F.xxhash64("text").alias("_text"), F.col("text"))
    items = saved(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
        .filter(F.size("words") > 0)
        .withColumn("span", F.least(F.size("words"), F.lit(span))),
        "benchmark-words",
    )
    lengths = [r["span"] for r in items.select("span").distinct().collect()]  # span values at most
    if not lengths:
        lengths = [span]

    # items: kept hashes, and the text of each window with the items that have it
    item_hashes = reduce(
        DataFrame.unionByName, (kept_hashes(items.filter(F.col("span") == n), ["item_id"], n) for n in lengths)
    )
    item_hashes = saved(item_hashes.select("span", "hash").distinct(), "benchmark-hashes")
    starts = F.sequence(F.lit(0), F.size("words") - F.col("span"))
    texts = F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, F.col("span")), " "))
    item_windows = saved(items.select("item_id", "span", F.explode(texts).alias("window")).distinct(), "benchmark-windows")

    # documents: stretches whose kept hash is one of an item
    split = rows.select("_id", "_text", words(F.col("text")).alias("words"))
    doc_hashes = reduce(DataFrame.unionByName, (kept_hashes(split, ["_id", "_text"], n) for n in lengths))
    met = (
        doc_hashes.join(_small(item_hashes), ["span", "hash"], "left_semi")
        .groupBy("_id", "_text")
        .agg(F.collect_set(F.struct("span", "start", "windows")).alias("_met"))
    )
    met = saved(met, "met-hashes")

    # extend: the windows of these stretches, compared as text
    spread = F.flatten(
        F.transform(
            "_met",
            lambda r: F.transform(
                F.sequence(r["start"], r["start"] + r["windows"] - 1),
                lambda i: F.struct(r["span"].alias("span"), i.alias("start"), F.array_join(F.slice("words", i + 1, r["span"]), " ").alias("window")),
            ),
        )
    )
    windows = (
        rows.join(_small(met), ["_id", "_text"])
        # out of a generator, the words are a value that no later expression computes again
        .select("_id", "_text", F.explode_outer(F.array(words(F.col("text")))).alias("words"), "_met")
        .select("_id", "_text", spread.alias("_windows"))
        .select("_id", "_text", F.explode_outer("_windows").alias("_w"))
        .select("_id", "_text", "_w.span", "_w.start", "_w.window")
    )
    hits = windows.join(_small(item_windows), ["span", "window"])
    ends = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("span")).alias("end"))))
    covered = F.aggregate(
        ends,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["upto"]))).alias("n"),
            F.greatest(a["upto"], x["end"]).alias("upto"),
        ),
    )
    found = saved(
        hits.groupBy("_id", "_text").agg(
            covered["n"].cast("long").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("_items")
        ),
        "hits",
    )
    none = F.array().cast("array<string>")
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_user"),
        id_of.alias("_id"),
        F.xxhash64("text").alias("_text"),
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
    )
    return (
        whole.join(_small(found), ["_id", "_text"], "left")
        .withColumns(
            {
                "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"),
                "n_items": F.size(F.coalesce("_items", none)).cast("long"),
                "items_sha256": F.sha2(F.array_join(F.coalesce("_items", none), ","), 256),
            }
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
        .select("_user", *NEW)
    )
