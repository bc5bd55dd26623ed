"""Near copies among embeddings by small-world graphs, one for each shard of a label.

Equal vectors of a label are one class. The classes of a label are dealt into shards by a hash, and each shard
gets a hierarchical navigable small-world graph, stored with its vectors. Every two shards of a label meet once:
the vectors of each are searched for in the graph of the other. A search keeps on as long as it meets vectors
within the threshold, however many there are; if they are very many, the vector is compared with
the whole shard instead, which then costs less. For each meeting a sample of the vectors is also searched for
exhaustively, and the beam is doubled until the graph finds what that finds; a beam as wide as the shard is
exhaustive itself. What is found is verified by its cosine in double precision.

Links are counted where they are found and never sent: a meeting of shards gives each vector its number of links and
the least key of its component, and those components are united over all meetings.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.session import saved

SHARD_ROWS = 32_768
LINKS, BUILD_BEAM = 12, 32
BEAM, AUDITS, RECALL = 32, 256, 0.99
#: with more links than this, a vector is compared with the whole shard
MANY = 128
SCAN_CELLS = 4 << 20


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest entry first, so that no square overflows."""
    rows = np.asarray(vectors, np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Graph:
    """A hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, units: np.ndarray, layers: list[dict[int, list[int]]] | None = None, entry: int = 0):
        self.units = units
        self.near = units.astype(np.float32)  # what searches go by
        self.layers, self.entry = layers or [], entry

    @classmethod
    def built(cls, units: np.ndarray) -> Graph:
        """The graph of all rows, inserted in their order; the same rows give the same graph."""
        graph = cls(units)
        draws = np.random.default_rng(len(units)).random(len(units))
        for i, draw in enumerate(draws.tolist()):
            graph._insert(i, int(-math.log(1 - draw) / math.log(LINKS)))
        return graph

    def _insert(self, node: int, level: int) -> None:
        q, top = self.near[node], len(self.layers) - 1
        at = [self.entry]
        for layer in range(top, level, -1):
            at = [self._search(q, at, 1, layer)[0][1]]
        for layer in range(min(level, top), -1, -1):
            found = self._search(q, at, BUILD_BEAM, layer)
            links, most = self.layers[layer], LINKS * (2 if layer == 0 else 1)
            links[node] = self._pick(found, LINKS)
            for j in links[node]:
                links[j].append(node)
                if len(links[j]) > most * 3 // 2:
                    sims = (self.near[links[j]] @ self.near[j]).tolist()
                    links[j] = self._pick(sorted(zip(sims, links[j], strict=True), reverse=True), most)
            at = [j for _, j in found]
        if level > top:
            self.layers.extend({node: []} for _ in range(level - top))
            self.entry = node

    def _pick(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of candidates, nearest first, those nearer to the node than to one picked before; then the nearest others."""
        if len(found) <= most:
            return [j for _, j in found]
        rows = self.near[[j for _, j in found]]
        between = (rows @ rows.T).tolist()
        picked: list[int] = []
        for a, (sim, _) in enumerate(found):
            row = between[a]
            if all(row[b] < sim for b in picked):
                picked.append(a)
                if len(picked) == most:
                    break
        chosen = set(picked)
        picked += [a for a in range(len(found)) if a not in chosen][: most - len(picked)]
        return [found[a][1] for a in picked]

    def _search(self, q: np.ndarray, entries: list[int], beam: int, layer: int, keep: float = 2.0, many: float = math.inf):
        """(similarity, node) of the ``beam`` nearest that best-first steps reach, and of all that are at least ``keep``.

        Gives up, with None, at more than ``many`` of the latter.
        """
        links, seen, kept = self.layers[layer], set(entries), 0
        best = sorted(zip((self.near[entries] @ q).tolist(), entries, strict=True))
        waiting = [(-s, i) for s, i in reversed(best)]
        while len(best) > beam and best[0][0] < keep:
            heapq.heappop(best)
        while waiting:
            s, i = heapq.heappop(waiting)
            if -s < keep and len(best) >= beam and -s < best[0][0]:
                break
            if -s >= keep:
                kept += 1
                if kept > many:
                    return None
            fresh = [j for j in links[i] if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for t, j in zip((self.near[fresh] @ q).tolist(), fresh, strict=True):
                if len(best) < beam or t > best[0][0] or t >= keep:
                    heapq.heappush(waiting, (-t, j))
                    heapq.heappush(best, (t, j))
                    if len(best) > beam and best[0][0] < keep:
                        heapq.heappop(best)
        return sorted(best, reverse=True)

    def within(self, q: np.ndarray, least: float, beam: int) -> list[int] | None:
        """Rows found whose cosine with the unit vector ``q`` is at least ``least``; None if they are many."""
        near, at, keep = q.astype(np.float32), [self.entry], least - 1e-5
        for layer in range(len(self.layers) - 1, 0, -1):
            at = [self._search(near, at, 1, layer)[0][1]]
        found = self._search(near, at, beam, 0, keep, MANY)
        if found is None:
            return None
        rows = [j for s, j in found if s >= keep]
        return [j for j, s in zip(rows, (self.units[rows] @ q).tolist(), strict=True) if s >= least] if rows else []

    def packed(self) -> dict[str, np.ndarray]:
        out = {"entry": np.array([self.entry]), "layers": np.array([len(self.layers)])}
        for k, links in enumerate(self.layers):
            out[f"nodes{k}"] = np.array(list(links), np.int32)
            out[f"sizes{k}"] = np.array([len(x) for x in links.values()], np.int32)
            out[f"links{k}"] = np.array([j for x in links.values() for j in x], np.int32)
        return out

    @classmethod
    def unpacked(cls, units: np.ndarray, held) -> Graph:
        layers = []
        for k in range(int(held["layers"][0])):
            ends, flat = np.cumsum(held[f"sizes{k}"]).tolist(), held[f"links{k}"].tolist()
            starts = [0, *ends[:-1]]
            layers.append({i: flat[a:b] for i, a, b in zip(held[f"nodes{k}"].tolist(), starts, ends, strict=True)})
        return cls(units, layers, int(held["entry"][0]))


def scan(units: np.ndarray, queries: np.ndarray, least: float):
    """(first, mask) for blocks of queries: which rows have at least that cosine with each."""
    step = max(1, SCAN_CELLS // max(1, len(units)))
    for at in range(0, len(queries), step):
        yield at, queries[at : at + step] @ units.T >= least


def audited_beam(graph: Graph, queries: np.ndarray, least: float) -> int:
    """The beam with which the graph finds RECALL of the links of AUDITS queries, spread over all of them."""
    sample = queries[np.unique(np.linspace(0, len(queries) - 1, min(AUDITS, len(queries))).astype(int))]
    truth = [np.flatnonzero(row) for _, mask in scan(graph.units, sample, least) for row in mask]
    total, beam = sum(len(x) for x in truth), BEAM
    while beam < len(graph.units):
        found = 0
        for q, rows in zip(sample, truth, strict=True):
            got = graph.within(q, least, beam)
            found += len(rows) if got is None else len(got)
        if found >= RECALL * total:
            return beam
        beam *= 2
    return beam


class Meeting:
    """Links between the vectors of two shards, or inside one, collected from both sides."""

    def __init__(self, sizes: list[int], weights: np.ndarray):
        self.starts, self.weights = np.cumsum([0, *sizes]), weights
        self.links = np.zeros(len(weights), np.int64)
        self.group = np.arange(len(weights))
        self.pairs: list[np.ndarray] = []
        self.whole = np.zeros(len(weights), bool)  # compared with all of the other side

    def search(self, graph: Graph, queries: np.ndarray, side: int, other: int, least: float) -> None:
        """Search for the vectors of one side in the other's graph."""
        first, base, own = int(self.starts[side]), int(self.starts[other]), side == other
        beam = audited_beam(graph, queries, least)
        dense = []
        for i, q in enumerate(queries):
            rows = graph.within(q, least, beam) if beam < len(graph.units) else None
            if rows is None:
                dense.append(i)
            elif rows := [j for j in rows if not (own and i == j)]:
                self.pairs.append(np.array([(first + i, base + j) for j in rows]))
        self.whole[[first + i for i in dense]] = True
        inside = slice(base, base + len(graph.units))
        for at, mask in scan(graph.units, queries[dense], least):
            for i, row in zip(dense[at : at + len(mask)], mask, strict=True):
                if own:
                    row[i] = False
                self.links[first + i] = row @ self.weights[inside]
                rows = base + np.flatnonzero(row)
                self._unite(np.append(rows, first + i))
                rest = rows[~self.whole[rows]] if own else rows
                if len(rest):
                    self.pairs.append(np.column_stack([np.full(len(rest), first + i), rest]))

    def _unite(self, members: np.ndarray) -> None:
        groups = np.unique(self.group[members])
        if len(groups) > 1:
            self.group[np.isin(self.group, groups)] = groups[0]

    def finish(self) -> None:
        """Count each pair once, whichever side found it."""
        if not self.pairs:
            return
        pairs = np.concatenate(self.pairs)
        pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
        pairs = pairs[~self.whole[pairs[:, 0]]]
        np.add.at(self.links, pairs[:, 0], self.weights[pairs[:, 1]])
        for i, j in pairs.tolist():
            if self.group[i] != self.group[j]:
                self._unite(np.array([i, j]))


SHARD = "label string, dims int, shard int, shards int, content binary"
FOUND = "key string, first_id long, copies long, links long, least string"


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: its graph and vectors, packed."""
    rows = rows.sort_values("key")
    raw = np.array(rows["embedding"].tolist(), np.float64)
    short = raw.astype(np.float32) if (np.abs(raw) < 3e38).all() else raw
    out = io.BytesIO()
    np.savez(
        out,
        vectors=short if (short == raw).all() else raw,
        keys=rows["key"].to_numpy().astype("S32"),
        first_id=rows["first_id"].fillna(0).to_numpy(np.int64),
        no_id=rows["first_id"].isna().to_numpy(),
        copies=rows["copies"].to_numpy(np.int64),
        **Graph.built(unit_rows(raw)).packed(),
    )
    head = rows.iloc[0]
    return pd.DataFrame(
        {"label": [head["label"]], "dims": [head["dims"]], "shard": [head["shard"]], "shards": [head["shards"]], "content": [out.getvalue()]}
    )


def _meet(least: float):
    def run(shards: pd.DataFrame) -> pd.DataFrame:
        """Two shards, or one with itself."""
        shards = shards.sort_values("shard")
        held = [np.load(io.BytesIO(c)) for c in shards["content"]]
        graphs = [Graph.unpacked(unit_rows(h["vectors"]), h) for h in held]
        keys = np.concatenate([h["keys"] for h in held]).astype(str)
        copies = np.concatenate([h["copies"] for h in held])
        meeting = Meeting([len(g.units) for g in graphs], copies)
        for side in range(len(graphs)):
            other = len(graphs) - 1 - side
            meeting.search(graphs[other], graphs[side].units, side, other, least)
        meeting.finish()
        # keys are in order inside a shard, not over both
        lowest = pd.Series(keys).groupby(meeting.group).transform("min")
        ids = np.concatenate([h["first_id"] for h in held])
        none = np.concatenate([h["no_id"] for h in held])
        out = pd.DataFrame(
            {"key": keys, "first_id": pd.array(ids, "Int64"), "copies": copies, "links": meeting.links, "least": lowest.to_numpy()}
        )
        out.loc[none, "first_id"] = pd.NA
        return out if len(held) == 1 else out[(out["links"] > 0).to_numpy()]

    return run


def _usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite entry, not all zero."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < F.lit(math.inf)) & ~F.isnan(c))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def near_copies(df: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``df`` (vec_id, embedding, label; others are not read).

    Vectors of the same label and length are linked if their cosine is at least ``least``; n_links is the number of other
    vectors linked directly, component_id the least vec_id that links reach, and kept says whether that is the row's own.
    Rows with a null label, and vectors that are null, empty, all zero or hold null or non-finite entries are linked with
    nothing. Repeated rows and rows with the same vec_id are vectors of their own. Rows without an id are linked and
    counted like others; a component of such rows only has a null id, and they are kept. An empty table gives no rows.

    The graphs find links by sampled audits of RECALL; a pair counts for both vectors if either search found it. Vectors
    equal to the last bit are one class, known by a 128-bit hash. Work grows with the vectors of a label times its shards.
    """
    plain = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    usable = F.col("label").isNotNull() & _usable(F.col("embedding"))
    both = [F.xxhash64(F.lit(seed), "label", "embedding") for seed in (1, 2)]
    key = F.concat(*(F.lpad(F.hex(h), 16, "0") for h in both))
    rows = plain.select("vec_id", "label", "embedding", F.when(usable, key).alias("key"))
    good = rows.filter("key is not null")

    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = classes.select("*", key.alias("key"), F.size("embedding").alias("dims"))
    shards = good.groupBy("label", F.size("embedding").alias("dims")).agg(
        F.ceil(F.approx_count_distinct("key") / SHARD_ROWS).cast("int").alias("shards")
    )
    dealt = classes.join(shards, ["label", "dims"]).withColumn("shard", F.pmod(F.xxhash64("key"), "shards").cast("int"))
    index = saved(dealt.groupBy("label", "dims", "shard").applyInPandas(_build, SHARD), "small-worlds")

    partner = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("partner")
    pairs = index.select("label", "dims", "shard", "content", partner).withColumns(
        {"low": F.least("shard", "partner"), "high": F.greatest("shard", "partner")}
    )
    found = saved(pairs.groupBy("label", "dims", "low", "high").applyInPandas(_meet(least), FOUND), "links")

    roots = components(found.select(F.col("key").alias("a"), F.col("least").alias("b")))
    totals = found.groupBy("key").agg(F.max("first_id").alias("first_id"), F.max("copies").alias("copies"), F.sum("links").alias("links"))
    placed = saved(
        totals.join(roots.withColumnRenamed("a", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "placed"
    )
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    results = placed.join(lowest, "root").select("key", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id")
    linked = good.select("vec_id", "key").join(saved(results, "components"), "key").select("vec_id", "n_links", "component_id")
    alone = rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
