"""The stages of the pipeline: brute force, odd rows, and columns of users with any name."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_cases import empty, jaccard, odd  # noqa: F401
from tidemark.llm import decontaminate, mixing, toxicity

STAGES = dict(corpus_pipeline.STAGES)
FOLDER = "/root/testdata/sf0.001"
CLASHING = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, epochs long, _source string,"
    " _id long, _text string, _items string, size long, target double, taken string, _user string, `a.b` int, _n int, n_hit int, _left int"
)


def words(text):
    lowered = (text or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER))
    return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in lowered).split(" ")


def windows(items):
    found = set()
    for text in items:
        w = [x for x in words(text) if x]
        n = min(10, len(w))
        found |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    return found


def contaminated(text, found):
    w = [x for x in words(text) if x]
    return any(tuple(w[i : i + n]) in found for n in {len(x) for x in found} for i in range(len(w) - n + 1))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def clashing(spark, odd):  # noqa: F811
    rows = [(*r[:5], 0.25, f"mine {i}", i, "src", -i, "t", "it", 7, 1.5, "tk", "u", i, 3, 4, 5) for i, r in enumerate(odd[1])]
    return spark.createDataFrame(rows, CLASHING), rows


def test_decontamination_stage(spark, documents):
    bench = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = windows(bench)
    rows = documents.collect()
    got = STAGES["decontamination"](spark, documents, FOLDER).collect()
    want = [r for r in rows if not contaminated(r["text"], found)]
    assert 0 < len(want) < len(rows)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_dedup_stage(spark, documents):
    rows = documents.collect()
    groups = {doc_id: root for doc_id, _, root in jaccard([(r["doc_id"], r["text"]) for r in rows])}
    got = STAGES["ngram_join"](spark, documents, FOLDER).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in rows if groups[r["doc_id"]] == r["doc_id"])


def test_mixing_stage(spark, documents):
    """Each document comes as often as its taken words say, as a whole, and sources come near their targets."""
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = STAGES["mixing"](spark, documents, FOLDER).collect()
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in documents.collect()}
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    names = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= full
    times = Counter(r["doc_id"] for r in got)
    assert max(times.values()) <= 2 and quality
    for s in names:
        mine = [i for i in size if source[i] == s and size[i]]
        taken = sum(times[i] * size[i] for i in mine)
        assert abs(taken - target[s]) <= max(size[i] for i in mine)
        # whole epochs come before a part of one
        assert max(times[i] for i in mine) - min(times[i] for i in mine) <= 1


def test_toxicity_stage(spark, documents):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in STAGES["toxicity"](spark, documents, FOLDER).collect()}
    for r in documents.collect():
        if r["doc_id"] in got:
            assert got[r["doc_id"]] == r
        else:
            assert labels.get(r["doc_id"]) != 0


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows_and_any_columns(spark, clashing, empty, name):  # noqa: F811
    docs, rows = clashing
    out = STAGES[name](spark, docs, FOLDER)
    if name == "sharding":
        assert out.count() == len(rows)
        return
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    known = Counter(map(str, docs.collect()))
    got = Counter(map(str, out.collect()))
    most = 2 if name == "mixing" else 1
    assert got and all(n <= most * known[r] for r, n in got.items())
    if name == "toxicity":
        assert sum(got.values()) >= len(rows) - 2
    if name == "decontamination":
        assert got == known
    assert STAGES[name](spark, docs.limit(0), FOLDER).collect() == []
    assert STAGES[name](spark, empty, FOLDER).columns == empty.columns


def test_operators_keep_columns_of_any_name(spark, clashing):
    docs, rows = clashing
    scored = toxicity.with_scores(docs, toxicity.Grammar({}, toxicity.UNTRAINED), "mine")
    assert Counter(map(str, scored.drop("mine").collect())) == Counter(map(str, docs.collect()))
    for out, new in (
        (mixing.with_taken(docs), mixing.NEW),
        (decontaminate.contamination(docs, spark.createDataFrame([(1, "one two")], "item_id long, text string")), decontaminate.NEW),
    ):
        kept = [f"`{c}`" for c in docs.columns if c not in new]
        assert out.columns == [c.strip("`") for c in kept] + new
        assert Counter(map(str, out.select(*kept).collect())) == Counter(map(str, docs.select(*kept).collect()))


def test_random_contamination(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4)]
    items = [" ".join(r.choices(vocabulary, k=r.randrange(14))) for _ in range(12)]
    texts = [" ".join(r.choices(vocabulary + ["x", "Y"], k=r.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = windows(items)
    got = {x["doc_id"] for x in decontaminate.clean(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == {i for i, t in enumerate(texts) if not contaminated(t, found)}
