"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each block of rows sorts the fingerprints (leading bits of SHA-256) of its texts and sends
   every owner of a fingerprint range one compressed list, each fingerprint once.
2. An owner decodes the lists it got and answers each with a bitmap: which entries came from
   another block too. (Repeats inside a block are known to the block.)
3. Rows whose fingerprint repeats are suspects. Only their texts are shuffled: they are grouped
   by the whole text, which compares its bytes.

A text in a third of all rows is one fingerprint per block and, as copies combine before their
shuffle, one text per task. What the blocks have sent is a table in the shared folder, so a lost
executor repeats only its own part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import golomb
from tidemark.session import saved

FINGERPRINT_BITS = 60
BLOCK_ROWS = 200_000
OWNER_ROWS = 2_000_000
BROADCAST_ROWS = 500_000

PACKET = (
    "block string, owner int, n int, k int, code binary, rank array<int>, local array<boolean>,"
    " row array<long>, doc_id array<long>, digest array<binary>, check array<long>"
)


def _packets(block: str, first: int, rows: pd.DataFrame, owners: int) -> pd.DataFrame:
    """What one block sends: a line per owner, with the sender's own columns beside the code."""
    heads = np.frombuffer(b"".join(rows["digest"]), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
    prints = heads >> np.uint64(64 - FINGERPRINT_BITS)
    span = np.uint64((1 << FINGERPRINT_BITS) // owners + 1)
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    borders = np.searchsorted(prints // span, np.arange(owners + 1, dtype=np.uint64))
    out = []
    for owner in range(owners):
        a, b = borders[owner], borders[owner + 1]
        if a == b:
            continue
        own, at = prints[a:b] - np.uint64(owner) * span, order[a:b]
        values, rank, counts = np.unique(own, return_inverse=True, return_counts=True)
        k, code = golomb.encode(values)
        part = rows.iloc[at]
        out.append(
            (block, owner, len(values), k, code, rank.tolist(), (counts[rank] > 1).tolist())
            + ((first + at).tolist(), [None if pd.isna(x) else int(x) for x in part["doc_id"]])
            + (part["digest"].tolist(), part["check"].tolist())
        )
    return pd.DataFrame(out, columns=[x.split()[0] for x in PACKET.split(", ")])


def _send(owners: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, size, number = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= BLOCK_ROWS:
                yield _packets(f"{task}.{number}", (task << 32) + number * 2 * BLOCK_ROWS, pd.concat(held), owners)
                held, size, number = [], 0, number + 1
        if size:
            yield _packets(f"{task}.{number}", (task << 32) + number * 2 * BLOCK_ROWS, pd.concat(held), owners)

    return run


def _answer(sent: pd.DataFrame) -> pd.DataFrame:
    """One owner: for each list it got, a bitmap of the entries that another list has too."""
    lists = [golomb.decode(n, k, c) for n, k, c in zip(sent["n"], sent["k"], sent["code"], strict=True)]
    _, back, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    marks = np.split(counts[back] > 1, np.cumsum([len(x) for x in lists])[:-1])
    return pd.DataFrame(
        {"block": sent["block"], "owner": sent["owner"], "bitmap": [np.packbits(m).tobytes() for m in marks]}
    )


def _mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each list, with their bit."""
    for batch in batches:
        for p in batch.itertuples():
            bits = np.unpackbits(np.frombuffer(p.bitmap, np.uint8), count=p.n).astype(bool)
            yield pd.DataFrame(
                {
                    "row": p.row,
                    "doc_id": pd.array([None if x is None or pd.isna(x) else int(x) for x in p.doc_id], "Int64"),
                    "digest": list(p.digest),
                    "check": p.check,
                    "suspect": bits[np.asarray(p.rank)] | np.asarray(p.local, bool),
                }
            )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    ``docs`` has doc_id and text; other columns are not read. A null text counts as empty, so null
    and empty texts are one group. Of equal texts the row with the largest doc_id stays, a null id
    being the smallest; of repeated rows with that id one stays. An empty table gives no rows.
    """
    spark = docs.sparkSession
    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({"digest": F.unhex(F.sha2("text", 256)), "check": F.xxhash64("text")})
    owners = docs.count() // OWNER_ROWS + 1
    sent = saved(hashed.select("doc_id", "digest", "check").mapInPandas(_send(owners), PACKET), "fingerprints")
    answers = (
        sent.select("block", "owner", "n", "k", "code")
        .groupBy("owner")
        .applyInPandas(_answer, "block string, owner int, bitmap binary")
    )
    marked = saved(
        sent.join(answers, ["block", "owner"])
        .select("n", "rank", "local", "row", "doc_id", "digest", "check", "bitmap")
        .mapInPandas(_mark, "row long, doc_id long, digest binary, check long, suspect boolean"),
        "marked",
    )
    suspects = marked.filter("suspect")
    # known before the texts move: if there are few, no other text is shuffled at all
    digests = saved(suspects.select("digest").distinct(), "suspect-digests")
    digests = F.broadcast(digests) if digests.count() <= BROADCAST_ROWS else digests
    groups = (
        hashed.join(digests, "digest", "left_semi")
        .groupBy("digest", "check", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .drop("text")
    )
    groups = saved(groups, "copies")
    rows = suspects.join(groups, ["digest", "check"])
    stays = (
        rows.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest", "check")
        .agg(F.min("row").alias("_stays"))
    )
    stays = saved(stays, "stays")
    found = rows.join(stays, ["digest", "check"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("_stays")).alias("kept"), "digest"
    )
    alone = marked.filter("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    return found.unionByName(alone).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
