"""Jaccard join of n-gram sets through prefix trees.

Two texts are linked if the sets of their distinct 5-word shingles have a Jaccard similarity of at
least 3/4. All pairs are found; what is returned are their components.

1. Equal sets are one class, known by a digest. The rest works on classes.
2. Blocks of documents send hashes of their shingles, sorted and Golomb-coded, to owners of hash
   ranges; an owner answers how many documents have each. In the first exchange a document sends
   the part of its shingles that comes first in a fixed order; if fewer of these are shared than
   any partner needs to share, it has no partner. That leaves few documents.
3. The rest exchange all shingles and get the global order, rarest first. In this order two alike sets
   share a shingle among the first quarter of either. Documents that share one are joined
   to candidate groups (components over shingle hubs, not pairs).
4. Each candidate group is stored as a prefix tree in one order of n-grams and searched with shared
   partial overlaps, leaving subtrees that cannot make up the overlap. A group that is too large
   for a task is cut: what is alike to one of its sets (a pivot) is linked already, and the others meet
   all members block by block.

Shingles are compared by 52 bits of a hash. A text in a third of all rows is one class; a shingle
in a third of all texts counts once per block and comes last in the order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import golomb, ngram_trie
from tidemark.llm.components import components
from tidemark.session import saved

WORDS = 5
BITS = 52
BLOCK_TOKENS = 1_000_000
OWNER_BYTES = 12 << 20
GROUP_SETS = 4_000
GROUP_TOKENS = 3_000_000
BROADCAST_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MASK = np.uint64((1 << BITS) - 1)
# any odd numbers with mixed bits will do
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * FACTOR
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of 1 to 4 words is one shingle.

    Texts come with A-Z in lower case already.
    """
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten()
    ends = lists.offsets.to_numpy()
    codes = flat.dictionary_encode()
    names = codes.dictionary.to_pylist()
    hashes = pd.util.hash_array(np.array([*names, ""], dtype=object), categorize=False)
    full = np.array([x != "" for x in [*names, ""]])
    index = codes.indices.to_numpy()
    word, keep = hashes[index], full[index]
    upto = np.concatenate([[0], np.cumsum(keep)])
    word, ends = word[keep], upto[ends - ends[0]]
    rolled = word[: max(0, len(word) - WORDS + 1)].copy()
    for i in range(1, WORDS):
        rolled = rolled * FACTOR + word[i : i + len(rolled)]
    rolled = _mixed(rolled) & MASK
    out = []
    for a, b in zip(ends, ends[1:], strict=False):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for w in word[a:b]:
                one = np.uint64((int(one) * int(FACTOR) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(_mixed(np.array([one])) & MASK)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def misses(n):
    """How many of its ``n`` shingles a set may lack in a set that is alike to it."""
    return n - (3 * n + 3) // 4


def first_part(tokens: np.ndarray) -> np.ndarray:
    """The shingles of a set that come first in a fixed order: what it may lack, and 5 % more."""
    many = misses(len(tokens)) + (len(tokens) + 19) // 20
    if many >= len(tokens):
        return tokens
    return np.sort(tokens[np.argpartition(_mixed(tokens + np.uint64(1)), many - 1)[:many]])


def needed(n):
    """How many of its first part a set has to share: 5 % of the smallest partner's size."""
    return (3 * n + 79) // 80


# ---------------------------------------------------------------- exchange

PACKET = (
    "block string, owner int, n int, k int, code binary, times binary, sets binary,"
    " digests array<binary>, sizes array<int>, ids array<string>, rows array<int>"
)


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


class Block:
    """Documents of one task, up to a number of shingles."""

    def __init__(self, part: bool):
        self.part, self.known = part, {}
        self.digests, self.sizes, self.tokens, self.ids, self.rows, self.held = [], [], [], [], [], 0

    def add(self, doc_id: str, tokens: np.ndarray) -> None:
        digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
        if digest not in self.known:
            self.known[digest] = len(self.digests)
            self.digests.append(digest)
            self.sizes.append(len(tokens))
            tokens = first_part(tokens) if self.part else tokens
            self.tokens.append(tokens)
            self.held += len(tokens)
        self.ids.append(doc_id)
        self.rows.append(self.known[digest])

    def packets(self, name: str, owners: int) -> pd.DataFrame:
        """What goes to each owner, and a row (owner -1) that tells which documents have which set."""
        tokens = np.concatenate(self.tokens)
        at = np.repeat(np.arange(len(self.tokens), dtype=np.uint32), [len(t) for t in self.tokens])
        order = np.argsort(tokens, kind="stable")
        tokens, at = tokens[order], at[order]
        span = np.uint64((1 << BITS) // owners + 1)
        borders = np.searchsorted(tokens, np.arange(owners + 1, dtype=np.uint64) * span)
        out = [(name, -1, 0, 0, None, None, None, self.digests, self.sizes, self.ids, self.rows)]
        for owner in range(owners):
            a, b = borders[owner], borders[owner + 1]
            if a < b:
                starts = np.flatnonzero(np.diff(tokens[a:b], prepend=tokens[a] + np.uint64(1)))
                k, code = golomb.encode(tokens[a:b][starts] - np.uint64(owner) * span)
                times = np.diff(np.append(starts, b - a)).astype(np.uint32)
                out.append((name, owner, len(starts), k, code, _pack(times), _pack(at[a:b]), None, None, None, None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in PACKET.split(", ")])


def _send(owners: int, part: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, block = TaskContext.get().partitionId(), 0, Block(part)
        schema = pa.schema(
            [("block", pa.string()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("code", pa.binary())]
            + [("times", pa.binary()), ("sets", pa.binary()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32()))]
            + [("ids", pa.list_(pa.string())), ("rows", pa.list_(pa.int32()))]
        )

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(block.packets(f"{task}.{number}", owners), schema, preserve_index=False)

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some = batch.slice(start, 1000)
                for doc_id, tokens in zip(some.column(0).to_pylist(), shingle_sets(some.column(1)), strict=True):
                    block.add(doc_id, tokens)
                    if block.held >= BLOCK_TOKENS:
                        yield out()
                        number, block = number + 1, Block(part)
        if block.ids:
            yield out()

    return run


def _count(sent: pd.DataFrame) -> pd.DataFrame:
    """One owner: for each list it got, how many documents have each entry.

    0: this one only, else 1 + the whole part of the logarithm to base 2.
    """
    lists = [golomb.decode(n, k, c) for n, k, c in zip(sent["n"], sent["k"], sent["code"], strict=True)]
    times = np.concatenate([_unpack(t, np.uint32) for t in sent["times"]])
    _, back = np.unique(np.concatenate(lists), return_inverse=True)
    counts = np.bincount(back, times)[back]
    classes = np.where(counts > 1, 1 + np.log2(np.maximum(counts, 1)).astype(np.uint8), 0).astype(np.uint8)
    parts = np.split(classes, np.cumsum([len(x) for x in lists])[:-1])
    return pd.DataFrame({"block": sent["block"], "owner": sent["owner"], "classes": [_pack(p) for p in parts]})


def _shared_sets(packets: pd.DataFrame) -> pd.DataFrame:
    """One block after the first exchange: the digests of sets that may have a partner."""
    meta = packets[packets["owner"] < 0].iloc[0]
    sizes = np.asarray(meta["sizes"], np.int64)
    shared = np.zeros(len(sizes), np.int64)
    for p in packets[packets["owner"] >= 0].itertuples():
        classes = np.repeat(_unpack(p.classes, np.uint8), _unpack(p.times, np.uint32))
        shared += np.bincount(_unpack(p.sets, np.uint32)[classes > 0], minlength=len(sizes))
    alive = np.flatnonzero((sizes > 0) & (shared >= needed(sizes)))
    return pd.DataFrame({"digest": [meta["digests"][i] for i in alive]}, dtype=object)


SETS = "digest binary, n int, prefix int, tokens array<long>"


def _ordered_sets(owners: int):
    span = np.uint64((1 << BITS) // owners + 1)

    def run(packets: pd.DataFrame) -> pd.DataFrame:
        """One block after the second exchange: sets that may have a partner, in global order.

        Shingles that no other set has come first in it and are left out; ``prefix`` is how many of the
        others belong to the first quarter.
        """
        meta = packets[packets["owner"] < 0].iloc[0]
        sizes = np.asarray(meta["sizes"], np.int64)
        tokens, classes, at = [], [], []
        for p in packets[packets["owner"] >= 0].itertuples():
            times = _unpack(p.times, np.uint32)
            kinds = np.repeat(_unpack(p.classes, np.uint8), times)
            values = np.repeat(golomb.decode(p.n, p.k, p.code) + np.uint64(p.owner) * span, times)
            keep = kinds > 0
            tokens.append(values[keep])
            classes.append(kinds[keep])
            at.append(_unpack(p.sets, np.uint32)[keep])
        tokens, classes, at = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (tokens, classes, at))
        order = np.lexsort((tokens, classes, at))
        shared = np.bincount(at.astype(np.int64), minlength=len(sizes))
        ends = np.cumsum(shared)
        prefix = misses(sizes) + 1 - (sizes - shared)
        alive = np.flatnonzero((prefix > 0) & (shared > 0))
        values = tokens[order].astype(np.int64)
        return pd.DataFrame(
            {
                "digest": pd.Series([meta["digests"][i] for i in alive], dtype=object),
                "n": sizes[alive].astype(np.int32),
                "prefix": prefix[alive].astype(np.int32),
                "tokens": pd.Series([values[ends[i] - shared[i] : ends[i]] for i in alive], dtype=object),
            }
        )

    return run


def _exchange(texts: DataFrame, part: bool) -> tuple[DataFrame, DataFrame, int]:
    """(packets, packets with answers, owners) of ``texts`` (id, text)."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    owners = int(size // (OWNER_BYTES * (3 if part else 1))) + 1
    kinds = PACKET
    sent = saved(texts.mapInArrow(_send(owners, part), kinds), "packets")
    answers = (
        sent.filter("owner >= 0")
        .select("block", "owner", "n", "k", "code", "times")
        .groupBy("owner")
        .applyInPandas(_count, "block string, owner int, classes binary")
    )
    return sent, sent.drop("ids", "rows").join(answers, ["block", "owner"], "left"), owners


# ---------------------------------------------------------------- groups


def _by_group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components inside each candidate group; a partition comes sorted by group."""

    def done(rows: list) -> pd.DataFrame:
        digests = [r.digest for r in rows]
        root = ngram_trie.linked([np.asarray(r.tokens, np.int64) for r in rows], [int(r.n) for r in rows])
        pairs = [(digests[i], digests[j]) for i, j in enumerate(root) if i != j]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype=object)

    rows: list = []
    for batch in batches:
        for row in batch.itertuples():
            if rows and row.part != rows[0].part:
                yield done(rows)
                rows = []
            rows.append(row)
    if rows:
        yield done(rows)


def _grouped(members: DataFrame) -> DataFrame:
    """Edges (a, b) of spanning trees of the linked sets in each ``part`` of ``members``."""
    dealt = members.repartition("part").sortWithinPartitions("part", "digest")
    return dealt.select("part", "digest", "n", "tokens").mapInPandas(_by_group, "a binary, b binary")


def _large_parts(members: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, edges) of groups that are too large for one task.

    The set that is least by hash is the pivot of its group. Sets alike to it are linked to it; each
    of the others is in a block, and every such block meets every block of the group.
    """
    pivots = members.groupBy("group").agg(F.min(F.struct(F.xxhash64("digest").alias("h"), "digest", "n", "tokens")).alias("_p"))
    overlap = F.size(F.array_intersect("tokens", F.col("_p.tokens")))
    near = saved(
        members.join(pivots, "group").withColumn("near", 7 * overlap >= 3 * (F.col("n") + F.col("_p.n"))).select(
            "group", "digest", "n", "tokens", "near", F.col("_p.digest").alias("_pivot")
        ),
        "large-groups",
    )
    edges = near.filter("near").select(F.col("digest").alias("a"), F.col("_pivot").alias("b"))
    blocks = sizes.withColumn("_blocks", F.ceil(F.greatest(F.col("sets") / GROUP_SETS, F.col("tokens") / GROUP_TOKENS) * 2).cast("int"))
    dealt = near.join(blocks.select("group", "_blocks"), "group").withColumn(
        "_b", F.pmod(F.xxhash64("digest", F.lit("block")), F.col("_blocks")).cast("int")
    )
    # a block of others (x) meets block y if y holds no others, and y >= x of the blocks that do
    other = dealt.filter("not near").select("group", F.col("_b").alias("_x")).distinct()
    own = dealt.join(other, "group").withColumn("_y", F.col("_b"))
    first = own.filter("_x = _b and not near").withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    parts = first.unionByName(own).select(
        F.concat_ws(".", F.col("group").cast("string"), "_x", "_y").alias("part"), "digest", "n", "tokens"
    )
    return parts.dropDuplicates(["part", "digest"]), edges


def _links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between digests; their components are those of all links."""
    vertex = F.xxhash64("digest")
    postings = sets.select(vertex.alias("v"), F.explode(F.slice("tokens", 1, F.col("prefix"))).alias("token"))
    hubs = postings.groupBy("token").agg(F.min("v").alias("hub"), F.max("v").alias("_last")).filter("hub < _last")
    edges = postings.join(hubs, "token").select(F.col("v").alias("a"), F.col("hub").alias("b"))
    roots = components(edges)
    group = F.coalesce("root", "v")
    named = sets.withColumn("v", vertex).join(roots.withColumnRenamed("a", "v"), "v", "left").withColumn("group", group)
    named = saved(named.select("group", "digest", "n", "tokens"), "candidate-groups")
    sizes = named.groupBy("group").agg(F.count("*").alias("sets"), F.sum(F.size("tokens")).alias("tokens")).filter("sets > 1")
    sizes = saved(sizes, "group-sizes")
    large = (F.col("sets") > GROUP_SETS) | (F.col("tokens") > GROUP_TOKENS)
    small = named.join(sizes.filter(~large).select("group"), "group", "left_semi")
    found = saved(_grouped(small.withColumn("part", F.col("group").cast("string"))), "links")
    many = sizes.filter(large)
    if many.isEmpty():
        return found  # components already: each member is linked to the first of its own
    parts, edges = _large_parts(named.join(many.select("group"), "group", "left_semi"), many)
    roots = components(_grouped(parts).unionByName(edges))
    return found.unionByName(roots.withColumnRenamed("root", "b"))


def similar_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text).

    Other columns are not read. Words are what stands between ASCII white space, A-Z in lower case; a
    text of 1 to 4 words is one shingle, and a text without words (or null) is linked with nothing.
    component_id is the least doc_id of the documents reachable by links; a null id is never the least
    and a component of null ids only has none. Rows that repeat are linked like other equal texts.
    """
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    texts = docs.select(ids.alias("id"), F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("text"))
    sent, answered, _ = _exchange(texts, True)
    rows = (
        sent.filter("owner < 0")
        .select("digests", "sizes", F.explode(F.arrays_zip("ids", "rows")).alias("_r"))
        .select(
            F.col("_r.ids").alias("id"), F.get("digests", F.col("_r.rows")).alias("digest"), F.get("sizes", F.col("_r.rows")).alias("n_shingles")
        )
    )
    rows = saved(rows, "document-sets")
    alive = saved(answered.groupBy("block").applyInPandas(_shared_sets, "digest binary").distinct(), "alive")
    # classes are counted first, so that a large one meets the join as one row
    classes = rows.groupBy("digest").agg(F.min("id").alias("id"))
    chosen = saved(classes.join(alive, "digest", "left_semi").select("id").distinct(), "chosen")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    _, answered, owners = _exchange(texts.join(chosen, "id", "left_semi"), False)
    sets = saved(answered.groupBy("block").applyInPandas(_ordered_sets(owners), SETS).dropDuplicates(["digest"]), "sets")
    links = _links(sets).select(F.col("a").alias("digest"), F.col("b").alias("_root"))
    named = saved(
        rows.join(links, "digest", "left").select(
            F.when(F.col("id") != "", F.col("id")).cast("long").alias("doc_id"),
            F.col("n_shingles").cast("long").alias("n_shingles"),
            F.coalesce("_root", "digest").alias("_root"),
        ),
        "named",
    )
    # stored, so that the join is between two plain shuffles and Spark can split a large component
    least = saved(named.filter("n_shingles > 0").groupBy("_root").agg(F.min("doc_id").alias("_least")), "least")
    joined = named.join(least, "_root", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"))
