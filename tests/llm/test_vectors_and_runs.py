"""Whitening, periodic runs and near copies of embeddings against brute force, and with odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import hnsw, runs, whitening
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, key string, links long, n double, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2.0, "w") for r in rows], VECTORS)


def plain(df):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]


# --- whitening ---------------------------------------------------------------------------------------------


def check_whitening(got, rows, components=8):
    good = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in good])
    n, sums = len(x), x.sum(axis=0)
    deviation = sum(int(v) ** 2 for v in (n * x - sums).ravel().tolist())
    covariance = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    assert len(got) == n * len(values)
    assert {(r["n"], r["deviation"], r["deviation_digits"]) for r in got} == {(n, deviation, str(deviation))}
    assert max(r["identity_error"] for r in got) <= 1e-9 and len({r["identity_error"] for r in got}) == 1
    want = (x - sums / n) @ directions
    by_id = {}
    for r in got:
        by_id.setdefault((r["vec_id"], r["component"]), []).append(r)
    for k, value in enumerate(values):
        if value <= 1e-12 * values.sum():
            assert all(r["whitened"] is None for r in got if r["component"] == k + 1)
            continue
        w = want[:, k] / math.sqrt(value)
        signs = set()
        for (i, _), v in zip(good, w, strict=True):
            r = by_id[i, k + 1][0]
            assert abs(abs(r["whitened"]) - abs(v)) < 1e-6 * max(1, abs(v))
            assert r["explained"] == pytest.approx(value / np.trace(covariance), rel=1e-9)
            if abs(v) > 1e-6:
                signs.add(r["whitened"] * v > 0)
        assert len(signs) == 1


def test_whitening_query(spark):
    rows = plain(spark.read.parquet(f"{FOLDER}/embeddings.parquet"))
    check_whitening(QUERIES["op11_whitening"](spark, FOLDER).collect(), rows)


def test_whitening_of_odd_rows(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, s) for s in (1, 2, 3)], None) for i in range(40)]
    rows += [(None, [0.5, 1.0, 2.0], 1), (50, None, 1), (51, [1.0, None, 2.0], 1), (52, [1.0, float("nan"), 2.0], 1)]
    rows += [(53, [float("inf"), 0.0, 0.0], 1), (54, [-90.0, 90.0, 3.0], 1)]
    check_whitening(whitening.whitened(vectors(spark, rows + [rows[3]])).collect(), rows + [rows[3]])
    short = vectors(spark, rows + [(60, [1.0], 1), (61, [], 1)])
    assert whitening.whitened(short).filter("vec_id >= 60").count() == 0
    assert whitening.whitened(short, components=2).count() == 2 * 42
    assert whitening.whitened(short.limit(0)).collect() == []
    assert whitening.whitened(vectors(spark, rows[41:45])).collect() == []


def test_whitening_without_spread(spark):
    same = whitening.whitened(vectors(spark, [(1, [1.0, 2.0], 0)] * 3)).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same] == [(None, None, 0.0, 0)] * 6
    line = [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(9)]
    check_whitening(whitening.whitened(vectors(spark, line)).collect(), line)


def test_sums_are_exact_at_any_size(spark):
    rows = [(i, [c, -c], 0) for i, c in enumerate([1e15, -1e15, 3.0, 1e300, -1e300])]
    got = whitening.whitened(vectors(spark, rows)).collect()
    x = whitening._whole(np.array([v for _, v, _ in rows])).astype(object)
    want = sum(int(v) ** 2 for v in (5 * x - x.sum(axis=0)).ravel())
    assert {r["deviation_digits"] for r in got} == {str(want)} and {r["deviation"] for r in got} == {None}


# --- runs --------------------------------------------------------------------------------------------------


def brute_runs(words):
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            unit = words[start : start + length]
            smaller = any(unit[q:] == unit[:-q] for q in range(1, p))
            if length >= max(6, 4 * p) and not smaller:
                out.append((start, length, p))
    return sorted(out)


def expected(words):
    found = brute_runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def longest_lyndon(words, i):
    return max(k for k in range(1, len(words) - i + 1) if all(words[i : i + k] < words[i + s : i + k] for s in range(1, k)))


def test_lyndon_arrays():
    r = random.Random(1)
    for _ in range(500):
        words = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randrange(25))]
        assert runs.lyndon_array(words) == [longest_lyndon(words, i) for i in range(len(words))]


def test_runs_of_sequences():
    r = random.Random(2)
    for _ in range(1500):
        words = []
        for _ in range(r.randrange(6)):
            unit = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randrange(1, 7))]
            words += (unit * r.randrange(1, 9))[: r.randrange(1, 60)]
        assert runs.runs(words) == brute_runs(words)


def test_runs_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words, h = (d["text"] or "").encode().split(), zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        r = got[d["doc_id"]]
        assert tuple(r[c] for c in r.__fields__[1:]) == expected(words)
    assert sum(r["n_runs"] > 0 for r in got.values()) > 5


def test_runs_of_odd_rows(spark):
    r = random.Random(3)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(60_000))
    texts = [None, "", " \t\n ", "a b " * 6, "x y\n" * 4, "a " * 5, "a " * 6, "la la la la la la lo lo lo lo lo lo", long, "\x0b ".join(["p q r"] * 5)]
    texts += [" ".join([long] * 4)]
    rows = [(i, t, "s", 5, "z") for i, t in enumerate(texts)] + [(None, texts[4], None, None, None), (4, texts[4], "s", 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, n_runs int, collapsed string")
    got = runs.document_runs(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] == 10:
            assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (1, 0, 240_000, 60_000, 4000)
            assert r["collapsed"] == long
        elif r["doc_id"] == 8:
            assert r["n_runs"] == 0 and r["collapsed"] == long
        elif r["doc_id"] is not None:
            assert tuple(r[c] for c in r.__fields__[1:8]) == expected((texts[r["doc_id"]] or "").encode().split())
    assert [r["n_runs"] for r in got if r["doc_id"] is None] == [1]
    assert runs.document_runs(docs.limit(0)).collect() == []
    spun = runs.with_repeated_tails(docs)
    assert spun.count() == len(rows) and spun.filter("doc_id is null").first()["text"] == texts[4]


# --- near copies -------------------------------------------------------------------------------------------


def brute_links(rows, least=0.93):
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def unit(v):
        if v is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        v = np.array(v) / max(abs(c) for c in v)
        return v / np.linalg.norm(v)

    units, links = [unit(v) for _, v, _ in rows], [0] * n
    for i in range(n):
        for j in range(i):
            alike = rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None
            if alike and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], links[i], min(ids, default=None), r[0] == min(ids, default=None)))
    return sorted(out, key=str)


def near(vector, spread, r):
    return [c + r.gauss(0, spread) for c in vector]


def groups(seed, dims=16, labels=3):
    """Single vectors, chains of near copies, a dense group and exact copies."""
    r = random.Random(seed)
    rows, make = [], lambda: [r.gauss(0, 1) for _ in range(dims)]
    rows += [(make(), r.randrange(labels)) for _ in range(150)]
    chain = make()
    for _ in range(40):
        chain = near(chain, 0.25, r)
        rows.append((chain, 1))
    centre, other = make(), make()
    rows += [(near(centre, 0.05, r), 1) for _ in range(250)] + [(other, 2)] * 60 + [(near(other, 0.1, r), 2) for _ in range(20)]
    r.shuffle(rows)
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


def test_near_copies_query(spark):
    rows = plain(spark.read.parquet(f"{FOLDER}/embeddings.parquet"))
    got = sorted(map(tuple, QUERIES["op13_embedding_near_dedup"](spark, FOLDER).collect()), key=str)
    assert got == brute_links(rows)


@pytest.mark.parametrize("size", [32_768, 90])
def test_near_copies_in_one_and_many_shards(spark, monkeypatch, size):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", size)
    rows = groups(size)
    want, got = brute_links(rows), sorted(map(tuple, hnsw.near_copies(vectors(spark, rows)).collect()), key=str)
    assert sum(r[1] for r in want) > 60_000
    assert got == want


def test_near_copies_of_odd_rows(spark):
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0)]
    rows += [(8, [1e300, 1e300], 0), (7, [1e-300, 1e-300], 0), (9, [1.0, 1.0], None), (10, [1.0, 1.0], 1), (11, [1.0, 1.0, 1.0], 0)]
    rows += [(7, [1.0, 1.01], 0), (None, [5.0, 5.0], 0), (None, [1.0, 1.0], 9), (None, [1.0, 1.0], 9), (None, None, 0), (12, [-1.0, -1.0], 0)]
    rows += [(13, [-0.0, 1.0], 2), (14, [0.0, 1.0], 2)]
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in hnsw.near_copies(vectors(spark, rows)).collect()]
    assert sorted(got, key=str) == [r[:3] for r in brute_links(rows)]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in hnsw.near_copies(vectors(spark, rows)).collect())
    assert hnsw.near_copies(vectors(spark, rows).limit(0)).collect() == []
    assert hnsw.near_copies(vectors(spark, rows[:1])).collect() == [(1, 0, 1, True)]


def test_graph_recall_against_brute_force():
    r = np.random.default_rng(5)
    units = hnsw.unit_rows(r.normal(size=(3000, 64)))
    units = np.concatenate([units, hnsw.unit_rows(units[:1000] + r.normal(size=(1000, 64)) * 0.03)])
    graph = hnsw.Graph.built(units)
    truth = units @ units.T >= 0.93
    beam = hnsw.audited_beam(graph, units, 0.93)
    found = sum(len(graph.within(q, 0.93, beam)) for q in units)
    assert found / truth.sum() >= 0.99 and beam < 512
    again = hnsw.Graph.unpacked(units, graph.packed())
    assert again.layers == graph.layers and again.entry == graph.entry
