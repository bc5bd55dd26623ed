"""Rows to text documents, and documents to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import double_text
from tidemark.functions.text import strip, words
from tidemark.operators.rules import payload_columns, row_column

# Label of each text part, in the order of the text.
TEXT_PARTS = [
    ("objective", "Objective: {}"),
    ("department", "Department: {}"),
    ("objective_type", "Type: {}"),
    ("priority", "Priority: {}"),
    ("status", "Status: {}"),
    ("quarter", "Quarter: {}"),
    ("progress", "Progress: {}%"),
    ("team_size", "Team Size: {} people"),
    ("budget", "Budget: ${}"),
    ("timeline_days", "Timeline: {} days"),
]
LABELS = ["department", "objective_type", "priority", "status"]


def _part(name: str, pattern: str) -> Column:
    c = F.col(name)
    if name == "progress":
        filled, shown = c.isNotNull(), double_text(c)
    elif name == "budget":
        filled, shown = c != 0, F.format_number(c, 2)
    elif name in ("team_size", "timeline_days"):
        filled, shown = c != 0, c.cast("string")
    else:
        filled, shown = c != "", c
    before, after = pattern.split("{}")
    return F.when(filled, F.concat(F.lit(before), shown, F.lit(after)))


def goal_documents(validated: DataFrame, as_of: Column) -> DataFrame:
    """``text``, ``labels`` (map) and ``meta`` (struct) of each validated goal row."""
    present = [(n, p) for n, p in TEXT_PARTS if n in validated.columns]
    labels = [n for n in LABELS if n in validated.columns]
    pairs = F.map_from_arrays(
        F.array(*[F.lit(n) for n in labels]), F.array(*[F.col(n) for n in labels])
    )
    errors = F.col("_validation_errors")
    meta = F.struct(
        F.col(row_column(validated, "source_file")).alias("source_file"),
        F.col(row_column(validated, "row_num")).alias("row_num"),
        F.col("_is_valid").alias("is_valid"),
        as_of.alias("processed_at"),
        F.struct(*payload_columns(validated)).alias("original_fields"),
        F.when(F.size(errors) > 0, errors).alias("validation_errors"),
    )
    return validated.select(
        F.array_join(F.array_compact(F.array(*[_part(n, p) for n, p in present])), ". ").alias("text"),
        F.map_filter(pairs, lambda k, v: F.coalesce(v != "", F.lit(False))).alias("labels"),
        meta.alias("meta"),
    )


def generic_documents(rows: DataFrame, as_of: Column) -> DataFrame:
    """All text columns joined by newline; the row goes under ``meta``."""
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    return rows.select(
        F.concat_ws("\n", *[F.col(f"`{c}`") for c in texts]).alias("text"),
        F.struct(F.struct(*rows.columns).alias("source_row"), as_of.alias("generated_at")).alias("meta"),
    )


def _windows(word_list: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, ``size - overlap`` apart; no words, no windows."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the window")
    count = F.size(word_list)
    starts = F.when(
        count > 0, F.sequence(F.lit(0), count - 1, F.lit(size - overlap))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(word_list, i + 1, F.lit(size)), " "))


def word_chunks(
    docs: DataFrame, keys: list[str], text: str = "text", size: int = 512, overlap: int = 64
) -> DataFrame:
    """One row per word window: keys, 0-based ``chunk_index``, ``chunk``.

    The words are a column of their own, so a text is split once and not per window.
    """
    split = docs.select(*keys, words(F.col(text)).alias("_words"))
    return _chunk_rows(split, keys, _windows(F.col("_words"), size, overlap))


def _chunk_rows(docs: DataFrame, keys: list[str], chunks: Column) -> DataFrame:
    # the inner explode would add a filter that computes the chunks a second time
    rows = docs.select(*keys, F.posexplode_outer(chunks).alias("chunk_index", "chunk"))
    return rows.filter(F.col("chunk").isNotNull())


def sentence_chunks(
    docs: DataFrame, keys: list[str], text: str = "text", tokens: int = 512, overlap: int = 64
) -> DataFrame:
    """Sentences gathered up to a word budget; each chunk starts with the tail of the last.

    One fold over the sentences of a document. The budget is three quarters of
    ``tokens``; the tail is the last ``overlap * 3/4`` entries of the chunk, where
    an entry is a sentence, or a word carried over from the chunk before.
    """
    budget, keep = int(tokens * 0.75), int(overlap * 0.75)
    parts = F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: strip(s)), lambda s: s != "")
    # out of a generator, the sentences are a value that no later expression computes again
    cut = docs.select(*keys, F.explode_outer(F.array(parts)).alias("_texts"), F.col(text).alias("_t"))
    sizes = F.transform("_texts", lambda s, i: F.struct(F.size(words(s)).alias("k"), i.alias("i")))
    cut = cut.select(*keys, "_texts", F.explode_outer(F.array(sizes)).alias("_s"), "_t")
    none = F.array().cast("array<string>")
    # The open chunk is the carried words and the sentences from ``first`` on.
    start = F.struct(
        none.alias("done"), none.alias("carried"), F.lit(0).alias("first"), F.lit(0).alias("n")
    )

    def entries(state: Column, end: Column) -> Column:
        since = F.slice("_texts", state["first"] + 1, end - state["first"])
        return F.concat(state["carried"], since)

    def step(state: Column, s: Column) -> Column:
        carried = F.size(state["carried"])
        is_open = carried + s["i"] > state["first"]
        full = is_open & (carried + state["n"] + s["k"] > budget)
        whole = entries(state, s["i"])
        tail = whole
        if keep:  # without an overlap the whole chunk is carried, as a slice from -0 takes all
            tail = F.when(F.size(whole) > keep, F.slice(whole, -keep, F.lit(keep))).otherwise(whole)
        closed = F.struct(
            F.array_append(state["done"], F.array_join(whole, " ")).alias("done"),
            # the carried text is cut into words again
            words(F.array_join(tail, " ")).alias("carried"),
            s["i"].alias("first"),
            s["k"].alias("n"),
        )
        grown = F.struct(
            state["done"].alias("done"),
            state["carried"].alias("carried"),
            state["first"].alias("first"),
            (state["n"] + s["k"]).alias("n"),
        )
        return F.when(full, closed).otherwise(grown)

    # A fold copies its state with every step, so the closed chunks are handed on block by block: what is
    # copied for n sentences grows with n * sqrt(n) instead of its square.
    size = F.greatest(F.lit(256), F.ceil(F.sqrt(F.size("_s")))).cast("int")
    number = F.ceil(F.size("_s") / size).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), number - 1), lambda b: F.slice("_s", b * size + 1, size))

    def block_step(outer: Column, block: Column) -> Column:
        opened = F.struct(
            none.alias("done"), outer["carried"].alias("carried"), outer["first"].alias("first"), outer["n"].alias("n")
        )

        def hand_on(state: Column) -> Column:
            return F.struct(
                F.concat(outer["done"], state["done"]).alias("done"),
                state["carried"].alias("carried"),
                state["first"].alias("first"),
                state["n"].alias("n"),
            )

        return F.aggregate(block, opened, step, hand_on)

    def finish(state: Column) -> Column:
        return F.array_append(state["done"], F.array_join(entries(state, F.size("_s")), " "))

    # without any sentence (only terminators) the words themselves are windowed
    chunks = F.when(F.size("_s") > 0, F.aggregate(blocks, start, block_step, finish)).when(
        strip(F.col("_t")) != "", _windows(words(F.col("_t")), budget, keep)
    )
    return _chunk_rows(cut, keys, chunks)


def curated_chunks(
    docs: DataFrame, limit: int = 384, size: int = 512, overlap: int = 64, text: str = "text"
) -> DataFrame:
    """Documents of more than ``limit`` words become one row per window, the others stay.

    Adds ``chunk_index``, ``total_chunks`` (null for whole documents) and ``is_chunked``.
    """
    rest = [c for c in docs.columns if c != text]
    split = docs.select(*rest, text, words(F.col(text)).alias("_words"))
    long = F.size("_words") > limit
    parts = F.when(long, _windows(F.col("_words"), size, overlap)).otherwise(F.array(text))
    out = split.select(*rest, long.alias("is_chunked"), parts.alias("_parts")).select(
        *rest,
        "is_chunked",
        F.size("_parts").alias("_total"),
        F.posexplode_outer("_parts").alias("_index", text),
    )
    return out.select(
        *rest,
        text,
        F.when(F.col("is_chunked"), F.col("_index")).alias("chunk_index"),
        F.when(F.col("is_chunked"), F.col("_total")).alias("total_chunks"),
        "is_chunked",
    )
