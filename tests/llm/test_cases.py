"""Odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import sys
import textwrap
from pathlib import Path

import pytest

from tidemark.llm import (
    components,
    decontaminate,
    exact_dedup,
    html_wrappers,
    licenses,
    mixing,
    ngram_join,
    shards,
    token_counts,
    toxicity,
    warc_zip,
)
from tidemark.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, group string, size string, owner string"
PAGES = "page_id long, url string, html string, host string, digest string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = words(60_000, 1)
    base = words(200, 2).split()
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 60, 6)]
    texts = [None, "", "   ", "one two", "One  two", long, long, "a idiot b", *near]
    rows = [(i, t, None, None if i % 5 == 0 else f"s{i % 3}", None, "g", "big", "me") for i, t in enumerate(texts)]
    rows += [(None, "no id", None, "s0", 1, None, None, None), rows[6], rows[6], (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_duplicates(odd, empty):
    docs, rows = odd
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(hashlib.sha256((r[1] or "").encode()).hexdigest(), []).append(r[0])
    for r in got:
        ids = by_text[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(by_text)
    assert exact_dedup.exact_duplicates(empty).collect() == []


def jaccard(rows):
    def grams(text):
        w = (text or "").translate(str.maketrans(ngram_join.UPPER, ngram_join.LOWER)).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def test_ngram_components(odd, empty):
    docs, rows = odd
    assert sorted(map(tuple, ngram_join.similar_components(docs).collect()), key=str) == jaccard(rows)
    assert ngram_join.similar_components(empty).collect() == []


def edited(n, edits, seed):
    """Texts at all distances from a common one, and chains of small steps."""
    r = random.Random(seed)
    base = words(120, seed).split()
    texts, last = [], base
    for i in range(n):
        last = list(base if i % 3 else last)
        for _ in range(r.randrange(edits)):
            last[r.randrange(len(last))] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(last[r.randrange(15) :]))
    return texts


def test_ngram_components_of_near_copies(spark):
    rows = [(i, t) for i, t in enumerate(edited(150, 9, 3) + edited(40, 3, 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.similar_components(docs).collect()), key=str) == jaccard(rows)


def test_large_groups_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 20)
    rows = [(i, t) for i, t in enumerate(edited(150, 9, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.similar_components(docs).collect()), key=str) == jaccard(rows)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(1, 41)] + [(101, 100)]


def test_token_tables(odd, empty):
    docs, rows = odd
    tables = token_counts.prefix_tables(docs, vocabulary())
    got = tables.withColumn("half", token_counts.longest_prefix("steps", tables["n_tokens"] / 2)).collect()
    assert len(got) == len(rows)
    counter = token_counts.PrefixCounter(vocabulary())
    for r in got:
        counts = token_counts.prefix_counts(r["steps"])
        assert counts[-1] == r["n_tokens"] and counts[r["half"]] <= r["n_tokens"] // 2
    for text in ["don't  we're\n\n x", "a <|endoftext|> b", "'re '", "  ", "é🙂 ß"]:
        counts = token_counts.prefix_counts(counter.table(text).tobytes())
        assert [int(counter.table(text[:i]).sum()) for i in range(len(text) + 1)] == counts.tolist()
    assert token_counts.prefix_tables(empty, vocabulary()).collect() == []


def test_token_memory_is_bounded_by_bytes(monkeypatch):
    """Texts without blanks, Chinese and base64-like, make each piece a new long key."""
    r = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x5200)]
    texts = ["".join(r.choices(letters, k=r.randrange(1, 900))) for _ in range(60)]
    texts += ["".join(r.choices("abcXYZ019+/", k=r.randrange(1, 900))) for _ in range(60)] + [words(50, i) for i in range(60)]
    free = token_counts.PrefixCounter(vocabulary())
    expected = [free.table(t).tobytes() for t in texts]
    monkeypatch.setattr(token_counts, "MEMORY", 20_000)
    bound = token_counts.PrefixCounter(vocabulary())
    for text, table in zip(texts, expected, strict=True):
        assert bound.table(text).tobytes() == table
        held = [x for m in (bound.pieces, bound.words, *bound.older) for x in m.items()]
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in held) <= 20_000
        assert all(len(k) <= token_counts.LONGEST for k, _ in held)
    assert sum(len(k) for k in [*free.pieces, *free.words]) > 10_000


def test_mixing(spark, odd, empty):
    docs, rows = odd
    got = mixing.with_taken(docs).collect()
    assert len(got) == len(rows)
    totals = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        totals.setdefault(r["source"], [r["target"], r["source_size"], 0])[2] += r["taken"]
    for target, size, taken in totals.values():
        assert target <= 2 * size and target - 4 <= taken <= target
    assert sum(t for t, _, _ in totals.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert sorted(map(str, mixing.with_taken(docs).collect())) == sorted(map(str, got))
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.with_taken(empty).collect() == []
    weights = spark.createDataFrame([(5, 9.0), (5, 1.0), (None, 3.0), (6, None), (7, -1.0)], "doc_id long, weight double")
    assert mixing.with_taken(docs, weights).count() == len(rows)


def test_shards(spark, odd, empty):
    docs, rows = odd
    got = shards.shard_rows(docs, 4).collect()
    assert len(got) == len(rows)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 4, len(rows) // 4 + 1)
    assert shards.shard_rows(empty, 4).collect() == []
    hot = spark.range(3000).selectExpr("id AS doc_id", "if(id < 1500, 'same', cast(id div 2 AS string)) AS text")
    placed = shards.shard_rows(hot, 24).toPandas()
    assert set(placed.groupby("shard").size()) == {125}
    assert (placed[placed["doc_id"] >= 1500].groupby("text_crc32")["shard"].nunique() == 1).mean() > 0.7


def test_contamination(spark, odd, empty):
    item = words(30, 9).split()
    bench = [(1, " ".join(item)), (2, "Idiot B"), (3, None), (4, ""), (None, " ".join(item[3:14])), (1, " ".join(item))]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    docs, rows = odd
    more = [(900, "x " + " ".join(item[2:13]).upper() + "; y"), (901, " ".join(item[2:11])), (902, " ".join(item + item))]
    both = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = {r["doc_id"]: r for r in decontaminate.contamination(both, bench).collect()}
    assert (got[900]["n_hit"], got[900]["n_items"], got[901]["n_hit"], got[902]["n_hit"]) == (11, 1, 0, 60)
    assert (got[7]["n_words"], got[7]["n_hit"]) == (3, 2)
    assert got[7]["items_sha256"] == hashlib.sha256(b"2").hexdigest()
    assert got[0]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs, bench).count() == len(rows)
    assert decontaminate.contamination(empty, bench).collect() == []


def test_contamination_is_linear_in_hits(spark):
    """A document that is all hit, 50,000 words long."""
    import time

    item = words(50_000, 11)
    docs = spark.createDataFrame([(1, item), (2, item + " x"), (3, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: 50_000, 2: 50_000, 3: 0} and time.time() - began < 60


def test_toxicity(spark, odd, empty):
    docs, rows = odd
    labels = spark.createDataFrame([(7, 1), (7, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs, labels).count() == len(rows)
    assert toxicity.toxicity_scores(empty, labels).collect() == []
    grammar = toxicity.learn(docs, labels.limit(0))
    assert grammar.weights == toxicity.UNTRAINED
    plain, negated, said, threat, word = (
        toxicity.score(t, grammar)
        for t in ["You are an idiot.", "You are not an idiot.", 'He said "idiot".', "I will kill you.", "They kill time."]
    )
    assert plain > 0.7 > max(negated, said, word) and threat > 0.7
    kept = toxicity.with_scores(docs, grammar).drop("score")
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_toxicity_keeps_other_columns(spark):
    docs = spark.sql("""SELECT 'a b' AS text, timestamp'2024-01-02 03:04:05.123456' AS at, timestamp_ntz'1800-01-02 03:04:05.000001' AS ntz,
        CAST(NULL AS BIGINT) AS n, map('k', CAST(NULL AS STRING)) AS m, array(named_struct('x', double('NaN'), 'd', 1.10bd)) AS l, X'00ff' AS b, 9007199254740993L AS big
        UNION ALL SELECT NULL, NULL, NULL, 5, NULL, NULL, NULL, NULL""")
    scored = toxicity.with_scores(docs, toxicity.Grammar({}, toxicity.UNTRAINED))
    assert scored.columns == [*docs.columns, "score"] and scored.dtypes[:-1] == docs.dtypes
    assert sorted(map(str, scored.drop("score").collect())) == sorted(map(str, docs.collect()))


def test_licenses(spark, odd, empty):
    mit = dict((a, b) for a, b in licenses.KNOWN if len(b) > 200)["MIT"]
    texts = ["Copyright (c) 2020 me\n" + mit.upper(), "x\nReleased under the MIT Licence\nreleased under the MIT license!", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, texts[1])], "doc_id long, text string")
    known = licenses.known_licenses(spark)
    got = sorted((r["doc_id"], r["license_id"], r["notices"], r["n_notices"]) for r in licenses.license_scan(docs, known).collect())
    assert got == [(0, "MIT", "", 0), (1, None, "MIT", 2), (1, None, "MIT", 2), (2, None, "", 0), (3, None, "", 0)]
    assert licenses.license_scan(odd[0], known).count() == len(odd[1])
    assert licenses.license_scan(empty, known).collect() == []


def test_licenses_in_any_wrapping(spark):
    mit = dict((a, b) for a, b in licenses.KNOWN if len(b) > 200)["MIT"]
    line = " ".join(mit.split())
    wrapped = ["\n".join(textwrap.wrap(line, n)) for n in (30, 60, 72, 78, 100)]
    assert any("\nCOPYRIGHT HOLDERS" in t for t in [mit, *wrapped]) and any("OR COPYRIGHT HOLDERS" in t for t in wrapped)
    notices = ["Copyright (c) 2020 me", "copyright 2019-2020 Me, Inc.\nAll rights reserved.", "© me", "Copyright The Me Authors", "(c) 2020 me"]
    titles = ["MIT License", "The MIT License (MIT)"]
    texts = [line, *wrapped, *(f"{n}\n\n{mit}" for n in notices), *(f"{t}\n\n{notices[0]}\n\n{w}" for t in titles for w in [line, *wrapped])]
    texts += [f"MIT License {notices[0]} {line}"]
    others = [line.replace("COPYRIGHT HOLDERS", ""), line.replace("NO EVENT", "ANY EVENT")]
    docs = spark.createDataFrame(list(enumerate(texts + others)), "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(docs, licenses.known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(got))] == ["MIT"] * len(texts) + [None] * len(others)


def test_licenses_in_full_and_inside_documents(spark):
    full = {p.name[:-4]: p.read_text() for p in Path(licenses.__file__).parent.joinpath("license_texts").iterdir()}
    assert sorted(full) == sorted(licenses.FULL)
    mit = dict((a, b) for a, b in licenses.KNOWN if len(b) > 200)["MIT"]
    isc, gpl, apache = full["ISC"], full["GPL-3.0"], full["Apache-2.0"]
    texts = [(i, i, "", 0) for i in full]
    texts = [(full[i], *x) for i, *x in texts] + [(" ".join(full[i].split()), i, i, 1) for i in ("GPL-3.0", "Apache-2.0", "MPL-2.0", "BSD-3-Clause")]
    texts += [
        ("Read me.\n\nMIT License\n\nCopyright (c) 2020 me\n\n" + mit + "\n\nThe end.", None, "MIT", 1),
        ("A\n\n" + isc + "\n\nB\n\n" + gpl + "\n\nC", None, "GPL-3.0,ISC", 2),
        ("/*\n * " + mit.replace("\n", "\n * ") + "\n */\n\nint main() {}", None, "MIT", 1),
        ("x\n\n" + apache[: apache.index("APPENDIX")], None, "Apache-2.0", 1),
        ("x\n\nThis work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.\n\ny", None, "CC-BY-SA-4.0", 1),
        ("// SPDX-License-Identifier: BSD-3-Clause\nx", None, "BSD-3-Clause", 1),
        (mit + "\n\n" + mit, None, "MIT", 2),
        ("MIT License\n\n" * 300, None, "", 0),
        ("x\n\n" + mit.replace("Software", "Thing") + "\n\ny", None, "", 0),
    ]
    docs = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    rows = licenses.license_scan(docs, licenses.known_licenses(spark)).collect()
    got = {r["doc_id"]: (r["license_id"], r["notices"], r["n_notices"]) for r in rows}
    assert len(rows) == 2 * len(texts) and [got[i] for i in range(len(texts))] == [t[1:] for t in texts]


def test_main_texts(spark):
    page = "<html><body><div class='top-menu'>Menu</div><div id=content><h2>{0}</h2><p>A &amp; {0}<p>b<i>c</i> {0}</div><div class=comments>no</div>"
    pages = [(i, "http://a.b/x", page.format(f"text number {i} of some length"), "h", "d") for i in range(6)]
    pages += [(None, None, None, None, None), (7, "x", "", None, None), (8, "http://c", "<p>" * 3000 + "deep <b>x", None, None)]
    pages += [(9, "http://d", "<article><p>one<div class='ad'>buy</div><ul><li>two<li>three</ul><script>var a='</p>'</script></article>tail", None, None)]
    got = {r["page_id"]: r["text"] for r in html_wrappers.main_texts(spark.createDataFrame(pages, PAGES)).collect()}
    assert got[2] == "text number 2 of some length A & text number 2 of some length bc text number 2 of some length"
    assert (got[None], got[7], got[8], got[9]) == ("", "", "deep x", "one two three")
    assert html_wrappers.main_texts(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("url", ["http://three.templates/{}", "no host {}"])
def test_main_texts_of_a_host_with_three_templates(spark, url):
    def page(i, kind):
        text = f"<h1>head {i}</h1><p>first text of page {i} about something</p><p>second text of page {i}</p>"
        around = {
            "article": "<div class=content><article>{}</article></div>",
            "main": "<main>{}</main>",
            "plain": "<div class=story>{}</div>",
            "small": "<div class=item><div class=inner>{}</div></div>",
        }
        return f"<html><body><nav><a href=/>home</a></nav>{around[kind].format(text)}<div class=sidebar>side {i}</div><footer>foot</footer></body></html>"

    want = "head {0} first text of page {0} about something second text of page {0}"
    kinds = [["article"] * 6 + ["main"] * 3 + ["plain"] * 2 + ["small"], ["plain"] * 20 + ["small"], ["main"] * 5 + ["plain"]]
    for n, templates in enumerate(kinds):
        rows = [(i, url.format(i) if n % 2 == 0 else f"http://{n}.x/{i}", page(i, k), None, None) for i, k in enumerate(templates)]
        got = {r["page_id"]: r["text"] for r in html_wrappers.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
        assert got == {i: want.format(i) for i in range(len(templates))}


def test_main_texts_of_deeply_nested_pages(spark):
    deep = ["<div>" * 20000, "<div>" * 20000, "<center>" * 20000 + "<p>", "<div class=a>" * 9000 + "<o:p>" * 9000, "<article>" + "<div>" * 5000 + "x</div>" * 5000]
    pages = [(i, "http://deep/x", f"{t}text of page {i}", None, None) for i, t in enumerate(deep)]
    pages += [(10, "http://other/x", "<article>" + "<div>" * 20000 + "one", None, None), (11, "http://other/y", "<article><p>two</article>", None, None)]
    got = {r["page_id"]: r["text"] for r in html_wrappers.main_texts(spark.createDataFrame(pages, PAGES)).collect()}
    assert [got[i] for i in range(4)] == [f"text of page {i}" for i in range(4)]
    assert got[4].split() == ["x"] * 5000 + "text of page 4".split() and (got[10], got[11]) == ("one", "two")
    wrapper = html_wrappers.wrapper_of(html_wrappers.page_tree("<h1>a</h1>" + "<div><p>b" * 500))
    assert html_wrappers.load(html_wrappers.dump(wrapper)) == wrapper


def test_main_texts_keep_what_only_sounds_like_boilerplate(spark):
    kept = [
        '<h2 id="related-work">a1</h2>', '<section id="search-algorithms"><p>a2</p><p>a3</p></section>', '<h3 id="social-impact">a4</h3>',
        '<pre><code><span class="k">if</span> x: <span class="comment"># a5</span></code></pre>', '<p id="share">a6</p>',
        '<p>a7 <span class="token comment">a8</span> <em class="related-work">a9</em></p>', '<div class="section" id="comments"><p>b1</p></div>',
        '<section id="notice"><p>b2</p></section>', '<div class="ad-hoc">b3</div>', '<div class="research-notes social-science">b4</div>',
    ]
    dropped = [
        '<div class="share-bar">n1</div>', '<div class="related-posts"><p>n2</p></div>', '<ul id="comments-list"><li>n3</ul>', '<div class="related">n4</div>',
        '<section class="comments"><p>n5</p></section>', '<div class="shareButtons">n6</div>', '<div role="search">n7</div>', '<p>b5 <span class="ad">n8</span></p>',
    ]
    want = "a1 a2 a3 a4 if x: # a5 a6 a7 a8 a9 b1 b2 b3 b4 b5"
    for around in ("<article>{}</article>", "<main>{}</main>"):
        page = "<html><body><div class='search-tools'>no</div>" + around.format("".join(kept + dropped)) + "<section id=comments>no</section>"
        rows = [(i, "http://names/x", page, None, None) for i in range(3)]
        got = {r["text"] for r in html_wrappers.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
        assert got == {want}


def test_main_texts_keep_all_that_an_article_holds(spark):
    shared = "<html><body><article><div>Read this first.</div><p>Body {0} of the text</p></article><div>Read this first.</div>"
    links = "<html><body><article><p>Text {0}</p><div><a href=/x>A long link that fills its block</a></div></article><div><a href=/y>Elsewhere on this site</a></div>"
    for around in ("article", "main"):
        for page, want in [(shared, "Read this first. Body {0} of the text"), (links, "Text {0} A long link that fills its block")]:
            page = page.replace("article", around)
            rows = [(i, f"http://whole/{i}", page.format(i), None, None) for i in range(7)]
            got = {r["page_id"]: r["text"] for r in html_wrappers.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
            assert got == {i: want.format(i) for i in range(7)}


def test_alignment_is_the_longest_common_subsequence(monkeypatch):
    r = random.Random(6)
    for _ in range(200):
        a, b = (r.choices("abcd", k=r.randrange(30)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        rest = html_wrappers._common_counts(a, b)
        assert all(rest(i, j) == best[i][j] for i in range(len(a) + 1) for j in range(len(b) + 1))
    monkeypatch.setattr(html_wrappers, "ALIGN_BITS", 50)
    one, two = (html_wrappers.wrapper_of(html_wrappers.page_tree("".join(f"<{t}>x</{t}>" for t in r.choices(["h1", "h2", "h3", "pre"], k=40)))) for _ in range(2))
    both = html_wrappers.merge(one, two)
    for w in (one, two):
        keys = iter(p[0] for p in both[4])
        assert all(p[0] in keys for p in w[4])


def test_unlike_pages_of_many_blocks(spark):
    import time

    r = random.Random(8)
    tags = [f"<{t} class=k{i}>" for t in ("p", "div", "h2", "pre") for i in range(12)]
    pages = [(k, "http://unlike/x", "<article>" + "".join(r.choice(tags) + f"w{k}x{i}" for i in range(20_000)), None, None) for k in range(4)]
    began = time.time()
    trees = [html_wrappers.wrapper_of(html_wrappers.page_tree(p[2])) for p in pages]
    wrapper = trees[0]
    for t in trees[1:]:
        wrapper = html_wrappers.merge(wrapper, t)
    assert time.time() - began < 60
    plan = html_wrappers.decide(wrapper)
    for k, _, page, *_ in pages:
        assert html_wrappers.extract(html_wrappers.page_tree(page), plan).split() == [f"w{k}x{i}" for i in range(20_000)]


def test_wrappers_align_options_and_groups():
    one, two = (html_wrappers.wrapper_of(html_wrappers.page_tree(s)) for s in ["<h1>a</h1><p>b<p>c", "<h1>a</h1><table></table><p>d"])
    both = html_wrappers.merge(one, two)
    assert [(p[0], p[1], p[2]) for p in both[4]] == [("h1", False, False), ("table", True, False), ("p", False, True)]


def test_archives(spark, tmp_path):
    same = "<p>" + "x" * 200
    pages = [(5, "u", same), (3, "u v", same), (3, "u v", same), (9, None, same), (None, "n", same), (1, "s", "short"), (2, "s", "short"), (4, "e", None)]
    pages = spark.createDataFrame([(*p, "h", "d") for p in pages], PAGES)
    for zip64 in (False, True):
        folder = f"file://{tmp_path}/packages-{zip64}"
        manifest = warc_zip.write_packages(pages, folder, zip64, package_bytes=600)
        assert manifest.agg({"records": "sum"}).first()[0] == 8
        got = warc_zip.read_packages(manifest, folder).collect()
        kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=str)
        assert kinds == sorted(
            [(5, "revisit", 3, 203), (9, "revisit", 3, 203), (None, "revisit", 3, 203), (3, "response", None, 203), (3, "response", None, 203)]
            + [(1, "response", None, 5), (2, "response", None, 5), (4, "response", None, 0)],
            key=str,
        )
        assert {bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {same, "short", ""}
    assert warc_zip.archive_round_trip(pages.limit(0)).collect() == []


def test_packages_are_zip_files(tmp_path):
    import zipfile

    for zip64 in (False, True):
        path = tmp_path / f"{zip64}.wacz"
        with open(path, "wb") as out:
            writer = warc_zip.PackageWriter(out, zip64)
            writer.add(warc_zip.record("response", 1, "u", b"data", "00"), page_id=1)
            writer.close()
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.namelist() == [warc_zip.ARCHIVE, warc_zip.INDEX]
        data = path.read_bytes()
        assert [p for _, p in warc_zip.package_records(lambda at, n: data[at : at + n], len(data))] == [b"data"]
