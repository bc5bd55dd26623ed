"""The registered queries against what defines their results."""

import hashlib
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, FOLDER).collect()]


def test_token_counts_equal_the_library(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, "op7_token_counts")
    assert len(got) == len(docs)
    for r in got:
        text = docs[r["doc_id"]]["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 1024)


def test_shards_are_even_and_gapless(spark, docs):
    got = rows(spark, "op9_sharding")
    assert Counter(r["doc_id"] for r in got) == Counter(docs.keys())
    slots = {}
    for r in got:
        data = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(docs)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_toxicity_scores(spark, docs):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = rows(spark, "op5_toxicity")
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert not [r for r in got if r["predicted"] and labels.get(r["doc_id"]) == 0]


def test_toxicity_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in QUERIES["op5_toxicity"](spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in got) / len(got) >= 0.95


def test_main_texts_are_articles(spark):
    import html
    import re

    got = {r["page_id"]: r for r in rows(spark, "op8_main_texts")}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>|<br>", " ", inner))
        assert got[p["page_id"]]["text"] == " ".join(html.unescape(plain).split())
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def test_pipeline_keeps_its_promises(spark, docs):
    got = rows(spark, "pipeline")
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    kept = {r["doc_id"] for r in got}
    texts = [docs[i]["text"] for i in kept]
    assert len({hashlib.sha256(t.encode()).digest() for t in texts}) == len(texts)
    scores = {r["doc_id"]: r["predicted"] for r in rows(spark, "op5_toxicity")}
    assert not [i for i in kept if scores[i]]
