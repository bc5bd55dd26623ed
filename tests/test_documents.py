import random
import re

from tidemark.operators import documents as D
from tidemark.operators import rules as R


def windows(text, size, overlap):
    w = text.split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size - overlap)]


def by_sentence(text, tokens, overlap):
    """Plain restatement: fill to the budget, then start again with the tail."""
    budget, keep = int(tokens * 0.75), int(overlap * 0.75)
    parts = [p.strip() for p in re.split("[.!?]+", text)]
    parts = [p for p in parts if p]
    if not parts:
        return windows(text, budget, keep)
    done, entries, count = [], [], 0
    for p in parts:
        size = len(p.split())
        if entries and count + size > budget:
            done.append(" ".join(entries))
            tail = entries if len(entries) <= keep else entries[len(entries) - keep :]
            entries = " ".join(tail).split()
            count = len(entries)
        entries = entries + [p]
        count += size
    return done + [" ".join(entries)]


def texts(seed):
    rng = random.Random(seed)
    out = ["", "   ", "...", "one", "a. b! c?", "x" * 50]
    for _ in range(20):
        out.append(" ".join("w%d%s" % (i, rng.choice(["", "", "", ".", "!\n", "　"])) for i in range(rng.randint(1, 400))))
    out.append(" ".join(f"w{i}" for i in range(900)))
    return out


def chunks(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["i"], r["chunk_index"])):
        got.setdefault(r["i"], []).append(r["chunk"])
    return got


def test_chunks_match_brute_force(spark):
    for seed in range(3):
        data = texts(seed)
        docs = spark.createDataFrame(list(enumerate(data)), "i int, text string")
        got = chunks(D.word_chunks(docs, ["i"], size=32, overlap=8))
        assert got == {i: c for i, t in enumerate(data) if (c := windows(t, 32, 8))}
        got = chunks(D.sentence_chunks(docs, ["i"], tokens=40, overlap=12))
        assert got == {i: c for i, t in enumerate(data) if t.strip() and (c := by_sentence(t, 40, 12))}


def test_windows_cover_every_word(spark):
    data = texts(9)
    docs = spark.createDataFrame(list(enumerate(data)), "i int, text string")
    got = chunks(D.word_chunks(docs, ["i"], size=16, overlap=4))
    for i, t in enumerate(data):
        assert set(t.split()) == {w for c in got.get(i, []) for w in c.split()}


def test_curated_keeps_short_text_as_it_is(spark):
    docs = spark.createDataFrame([(1, " short  text "), (2, "w " * 400)], "i int, text string")
    got = D.curated_chunks(docs, limit=384, size=200, overlap=50).collect()
    short = [r for r in got if r["i"] == 1]
    assert [(r["text"], r["is_chunked"], r["chunk_index"], r["total_chunks"]) for r in short] == [(" short  text ", False, None, None)]
    assert sorted(r["chunk_index"] for r in got if r["i"] == 2) == [0, 1, 2]


ROWS = "row_num int, source_file string, objective string, priority string, team_size string, progress string"


def test_rules(spark):
    df = spark.createDataFrame(
        [(1, "f", "Grow", "hIGH", "3", "120"), (2, "f", "ab", None, "0", "x"), (3, "f", "", " ", None, None),
         (4, "f", "Long enough", None, "inf", "nan")], ROWS,
    )
    got = {r["row_num"]: r for r in R.validate_goals(df).collect()}
    assert got[1]["_is_valid"] and got[1]["priority"] == "High" and got[1]["progress"] == 100.0
    assert got[2]["_validation_errors"] == ["Invalid or too short objective", "Team size must be positive"]
    assert got[3]["_validation_errors"] == ["Empty row", "Invalid or too short objective"]
    assert not got[4]["_is_valid"] and got[4]["team_size"] is None
    assert got[4]["_validation_errors"] == [
        "Invalid team_size: cannot convert float infinity to integer", "Progress must be between 0 and 100",
    ]
    assert sum(r["_is_valid"] for r in got.values()) + sum(not r["_is_valid"] for r in got.values()) == 4


def test_sentence_chunks_of_a_very_long_text(spark):
    """100,000 sentences in a time that goes with the text."""
    import time

    rng = random.Random(4)
    text = " ".join(" ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randint(1, 9))) + "." for _ in range(100_000))
    docs = spark.createDataFrame([(0, text)], "i int, text string")
    began = time.time()
    got = chunks(D.sentence_chunks(docs, ["i"]))
    assert got == {0: by_sentence(text, 512, 64)} and time.time() - began < 30
