"""Toxicity by a weighted finite-state grammar over clauses.

Four transducers read the words of a clause side by side, composed into one:

* a lexicon marks insults and threats (whole words, or stems that end in ``*``) with a weight;
* the negation transducer remembers a negation for the next three words;
* the reported-speech transducer remembers a verb of saying or a quotation mark to the clause's end;
* the target transducer remembers that somebody is addressed or named.

What comes out is a match with its weight and context; a clause counts, not the word alone. A
logistic model turns the best clause and the number of clauses into a score. Insults are learned
from labelled texts: words and stems whose documents are toxic more often than chance allows. The
model also learns what negation, report and target are worth, so they count for as much as
the labels show.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bound of the labelled sample that the model is fitted on, in expected rows.
TRAIN_ROWS = 30_000
STEMS = range(4, 8)
THRESHOLD = 0.7

# Words of the grammar, in English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid imbecile dumbass scumbag bastard bitch asshole"
    " dummkopf arschloch trottel vollidiot connard connasse salaud abruti pendejo cabrón gilipollas imbécil"
)
THREATS = "kill murder hurt destroy umbringen töten vernichten tuer détruire matar destruir"
TARGETS = "you your yours u him her them du dich dir euch ihr tu te toi vous tú ti usted ustedes vosotros"
NEGATIONS = "not no never isn't aren't don't wasn't nicht kein keine nie pas jamais aucun nunca jamás tampoco"
REPORTS = (
    "said says say called calls told tells wrote writes quoted sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió"
)
DEFAULT_WEIGHT = 3.0

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")
CLAUSE = re.compile(r"[.!?;:\n]+")
NEGATED, REPORTED, TARGETED, THREAT = 1, 2, 4, 8


class Grammar(NamedTuple):
    """Lexicon (word or stem with ``*`` -> weight), and the weights of the logistic model."""

    insults: dict[str, float]
    weights: list[float]


FEATURES = ["one", "match", "weight", "negated", "reported", "targeted", "threat", "clauses"]


def _composed() -> dict[tuple[tuple[int, int, int], str], tuple[tuple[int, int, int], int]]:
    """The product of the negation, report and target transducers.

    State (words the negation still covers, in reported speech, target seen) and symbol give the
    next state and the context that is put out with a match.
    """
    table = {}
    for scope in range(4):
        for report in range(2):
            for target in range(2):
                for symbol in ("word", "insult", "threat", "target", "negation", "report"):
                    after = (
                        3 if symbol == "negation" else max(0, scope - 1),
                        int(report or symbol == "report"),
                        int(target or symbol == "target"),
                    )
                    out = (NEGATED if scope else 0) | (REPORTED if report else 0) | (TARGETED if target else 0)
                    table[(scope, report, target), symbol] = (after, out | (THREAT if symbol == "threat" else 0))
    return table


TABLE = _composed()
SYMBOLS = (
    {w: "target" for w in TARGETS.split()}
    | {w: "negation" for w in NEGATIONS.split()}
    | {w: "report" for w in [*REPORTS.split(), *"\"“”„«»"]}
    | {w: "threat" for w in THREATS.split()}
)


def weight_of(word: str, insults: dict[str, float]) -> float:
    """Largest weight of the word or one of its stems; 0 if it is not an insult."""
    best = insults.get(word, 0.0)
    for n in STEMS:
        if len(word) > n:
            best = max(best, insults.get(word[:n] + "*", 0.0))
    return best


def clause_matches(words: list[str], insults: dict[str, float]) -> list[tuple[float, int]]:
    """(weight, context) of each match in a clause."""
    state, found, late = (0, 0, 0), [], 0
    for word in words:
        weight = weight_of(word, insults)
        symbol = "insult" if weight else SYMBOLS.get(word, "word")
        state, context = TABLE[state, symbol]
        if symbol == "insult" or symbol == "threat":
            found.append((weight or DEFAULT_WEIGHT, context))
        late |= symbol == "target"
    # a threat needs somebody it is meant for; a target may also follow what is said of it
    found = [(w, c | (TARGETED if late else 0)) for w, c in found]
    return [(w, c) for w, c in found if not c & THREAT or c & TARGETED]


def features(text: str, insults: dict[str, float]) -> list[float]:
    """What the model sees of a text: its best clause, and how many clauses match."""
    lowered = text.lower()
    words = set(WORD.findall(lowered))
    hits = {w for w in words if weight_of(w, insults)}
    threats = words & {w for w, s in SYMBOLS.items() if s == "threat"}
    if not hits and not threats:
        return [1.0, *[0.0] * 7]
    matches, clauses = [], 0
    for clause in CLAUSE.split(lowered):
        found = clause_matches(WORD.findall(clause), insults)
        matches += found
        clauses += bool(found)
    if not matches:
        return [1.0, *[0.0] * 7]
    weight, context = max(matches, key=lambda m: (not m[1] & THREAT, not m[1] & (NEGATED | REPORTED), m[0], bool(m[1] & TARGETED)))
    flags = [float(bool(context & x)) for x in (NEGATED, REPORTED, TARGETED, THREAT)]
    return [1.0, 1.0, weight / DEFAULT_WEIGHT, *flags, math.log1p(clauses)]


def score(text: str, grammar: Grammar) -> float:
    x = sum(a * b for a, b in zip(features(text, grammar.insults), grammar.weights, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


# ---------------------------------------------------------------- learning


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of either label that have a word or a stem, for the rows of one task."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            words = {w for w in WORD.findall(text.lower()) if len(w) > 1}
            words |= {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
            counts[int(toxic)].update(words)
    if counts[1]:
        yield pd.DataFrame({"word": list(counts[1]), "bad": list(counts[1].values()), "good": [counts[0][w] for w in counts[1]]})
    rest = [w for w in counts[0] if w not in counts[1]]
    yield pd.DataFrame({"word": rest, "bad": [0] * len(rest), "good": [counts[0][w] for w in rest]})


def learn_insults(sample: DataFrame) -> dict[str, float]:
    """Words and stems that toxic texts have and others hardly ever do, with log-odds weights.

    ``sample`` has text and toxic. A word has to be in so many toxic texts that not even one
    word of the vocabulary is expected to get there by chance, and in nine of ten cases the text has to
    be toxic.
    """
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    bad, good = int(totals["bad"]), int(totals["n"] - totals["bad"])
    base = {w: DEFAULT_WEIGHT for w in INSULTS.split()}
    if not bad or not good:
        return base
    counts = (
        sample.select("text", "toxic")
        .mapInPandas(_word_counts, "word string, bad long, good long")
        .groupBy("word")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    chance = math.log((bad + good) / bad)
    likely = F.col("bad") >= 9 * F.col("good")
    # the vocabulary is at most all words of a bounded sample; e to the chance * bad has to exceed it
    rows = counts.withColumn("_all", F.lit(1)).filter(likely & (F.col("bad") * chance >= 4)).collect()
    vocabulary = counts.filter("bad + good > 1").count()
    least = (math.log(max(vocabulary, 2)) + 1) / chance
    found = {
        r["word"]: math.log((r["bad"] + 0.5) / (bad + 1)) - math.log((r["good"] + 0.5) / (good + 1))
        for r in rows
        if r["bad"] >= least
    }
    return base | {w: x for w, x in found.items() if x > 0}


def _features(insults: dict[str, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[round(x, 3) for x in features(t, insults)] for t in batch["text"]]
            yield pd.DataFrame(rows, columns=FEATURES).assign(toxic=batch["toxic"].astype("int32").to_numpy())

    return run


def fit_weights(rows: list, ridge: float = 0.05) -> list[float]:
    """Logistic regression by Newton steps; rows are (features..., label, how often)."""
    data = np.array(sorted(tuple(r) for r in rows), float)
    x, y, n = data[:, : len(FEATURES)], data[:, -2], data[:, -1]
    pull = np.array([1e-3, *[ridge] * (len(FEATURES) - 1)])
    w = np.zeros(len(FEATURES))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (n * (y - p)) - pull * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return [round(float(v), 9) for v in w]


#: Without labels: a match of default weight scores 0.88, negated or reported 0.38, none 0.02.
UNTRAINED = [-4.0, 3.0, 3.0, -2.5, -2.5, 0.5, -0.5, 0.0]


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Grammar:
    """Grammar fitted to ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic).

    At most about ``train_rows`` labelled ids are used, picked by a hash of the id; that
    bound is what allows sending them to all tasks. Null labels and ids do not count, a null text
    is empty, and of repeated labels of one id the larger holds. Without labels of both kinds the
    fixed words and ``UNTRAINED`` weights are used.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = marks.count()
    part = min(1.0, train_rows / max(count, 1))
    picked = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    insults = learn_insults(sample)
    kinds = ", ".join(f"{x} double" for x in FEATURES) + ", toxic int"
    seen = sample.mapInPandas(_features(insults), kinds).groupBy(*FEATURES, "toxic").count().collect()
    if len({r["toxic"] for r in seen}) < 2:
        return Grammar(insults, UNTRAINED)
    return Grammar(insults, fit_weights(seen))


def _scored(grammar: Grammar, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([score(t or "", grammar) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    return run


def with_scores(docs: DataFrame, grammar: Grammar, name: str = "score") -> DataFrame:
    """``docs`` (all columns) with a column ``name``, 0 to 1; null and empty texts score as no match.

    A column of that name is replaced. Rows are independent and nothing is shuffled.
    """
    rest = docs.drop(name)
    # columns go by number, as their names may hold anything
    plain = rest.toDF(*(f"c{i}" for i in range(len(rest.columns))))
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    return plain.mapInArrow(_scored(grammar, rest.columns.index("text")), schema).toDF(*rest.columns, name)


def toxicity_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text).

    Ids with crc32 of their text modulo 3 = 1 are held out: their labels are not learned from. A
    null id is not held out. Other columns are not read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    grammar = learn(docs, labels.select("doc_id", "toxic").filter(~held), train_rows)
    rows = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), grammar)
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
