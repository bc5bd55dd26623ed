"""Periodic runs of words in documents, from Lyndon arrays.

The Lyndon array (the longest Lyndon word that starts at each place) comes straight out of the first
phase of Baier's suffix sorter: suffixes are grouped by their first word, and groups are taken from
the greatest down; the places just before a group's members are moved, old group by old group, into
new groups whose prefix is the old prefix followed by the group's. When it ends, the prefix of a
place's group is the longest Lyndon word there. Under one of the two orders of words (rising, falling)
each run has Lyndon roots, so both arrays together point at every run; a root is then extended in both
directions through longest common extensions.

A run is looked for only where one can be: each five consecutive words of a run occur again inside the
run, so stretches of a document whose five-word sequences occur once are passed over. This loses nothing,
see ``stretches``. A document is one row and stays in one task, whose work is about linear in its words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least LEAST words and TIMES periods. GRAM follows from them: a run of period q has
#: max(LEAST, TIMES * q) >= 2 * q + GRAM - 1 words, so any GRAM words in it are found again a period away.
LEAST, TIMES, GRAM = 6, 4, 5
NARROWINGS = 8


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place of ``ranks``, smaller ranks first."""
    number = {r: g for g, r in enumerate(sorted(set(ranks)))}
    group = [number[r] for r in ranks]
    members: list[list[int]] = [[] for _ in number]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    # left[i + 1] is i while place i waits for its group's turn, later a place left of it to look from
    left = list(range(-1, len(ranks)))
    at = len(members) - 1
    while at >= 0:
        here = [i for i in members[at] if group[i] == at]
        for i in here:
            left[i + 1] = i - 1
        hits: dict[int, int] = {}  # the nearest waiting places to the left, and of how many members
        for i in here:
            j = i - 1
            while (k := left[j + 1]) != j:
                left[j + 1] = left[k + 1]
                j = k
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        moved = defaultdict(list)
        for j, times in hits.items():
            moved[times, group[j]].append(j)
        # directly above the old group: more copies of the prefix come first and end up higher
        for times, old in sorted(moved, reverse=True):
            new, places = len(members), moved[times, old]
            for j in places:
                group[j] = new
            members.append(places)
            length.append(length[old] + times * length[at])
            below.append(old)
            above.append(above[old])
            if above[old] >= 0:
                below[above[old]] = new
            above[old] = new
        at = below[at]
    return [length[g] for g in group]


def _extension(a: np.ndarray, i: int, j: int) -> int:
    """How many entries a[i:] and a[j:] have in common from their start on, i < j."""
    done, step = 0, 16
    while j + done < len(a):
        to = min(step, len(a) - j - done)
        unlike = a[i + done : i + done + to] != a[j + done : j + done + to]
        if unlike.any():
            return done + int(unlike.argmax())
        done, step = done + to, step * 2
    return done


def _runs_of(words: np.ndarray) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words`` (numbers)."""
    n, found = len(words), set()
    back = words[::-1]
    for sign in (1, -1):
        root = np.array(lyndon_array((sign * words).tolist()))
        # a run of TIMES periods has at least TIMES - 1 whole roots in a row after its first word
        at = np.flatnonzero(np.arange(n) + (TIMES - 1) * root <= n)
        for k in range(1, TIMES - 1):
            at = at[root[at + k * root[at]] == root[at]]
        seen: dict[int, tuple[int, int]] = {}
        for i, p in zip(at.tolist(), root[at].tolist(), strict=True):
            start, end = seen.get(p, (0, 0))
            if start <= i and i + 2 * p <= end:
                continue
            end = i + p + _extension(words, i, i + p)
            if end < i + (TIMES - 1) * p:
                continue
            start = i - _extension(back, n - i - p, n - i)
            seen[p] = start, end
            if end - start >= max(LEAST, TIMES * p):
                found.add((start, end - start, p))
    return found


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """(from, to): parts of ``words`` (numbers) that hold all its runs.

    Of a run with period q and length L >= 4 q, any GRAM words are found again at distance q, at most a quarter of
    the part that the run lies in. What is not covered by such sequences is cut away, and the parts that
    remain are looked at again. Sequences are compared by hash: a collision keeps more, never less.
    """
    todo, out = [(0, len(words), 0)], []
    hashed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashed ^= hashed >> np.uint64(29)
    grams = np.zeros(max(len(words) - GRAM + 1, 0), np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(0xBF58476D1CE4E5B9) + hashed[k : k + len(grams)]
    while todo:
        start, end, times = todo.pop()
        if end - start < LEAST:
            continue
        part = grams[start : end - GRAM + 1]
        order = np.argsort(part, kind="stable")
        ranked = part[order]
        again = (ranked[1:] == ranked[:-1]) & (np.diff(order) <= max(1, (end - start) // TIMES))
        if not again.any():
            continue
        edge = np.zeros(end - start + 1, np.int64)
        places = np.union1d(order[1:][again], order[:-1][again])
        np.add.at(edge, places, 1)
        np.add.at(edge, places + GRAM, -1)
        steps = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)]))
        parts = list(zip((start + np.flatnonzero(steps == 1)).tolist(), (start + np.flatnonzero(steps == -1)).tolist(), strict=True))
        if parts == [(start, end)] or times == NARROWINGS:
            out.extend(parts)
        else:
            todo.extend((*p, times + 1) for p in parts)
    return sorted(out)


def runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of words, by start, then period."""
    number: dict = {}
    numbers = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    return sorted((a + s, n, p) for a, b in stretches(numbers) for s, n, p in _runs_of(numbers[a:b]))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """``words`` with only the first period of each run."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, x in zip(words, np.cumsum(gone).tolist(), strict=False) if not x]


OUTPUT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string,"
    " collapsed_sha256 string, collapsed string"
)


def document_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are not read), with its most repeated run.

    (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed): ``collapsed`` is
    the text's words, joined by one blank, without those that a run has after its first period. Words are what
    stands between blanks (space and tab to carriage return). A run is a longest stretch with one smallest period, at
    least six words and four periods long. Of runs with the same length by period, the first one and then the one of
    the smaller period is given; without a run start, length, period and exponent_milli are null. A null or empty text
    has no words and no runs; null ids and repeated rows are rows like any other; an empty table gives no rows. Texts
    of any length are read whole, each inside one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                found = runs(words)
                best = (None,) * 4
                if found:
                    # compared as fractions: length * other period
                    top = found[0]
                    for r in found[1:]:
                        if r[1] * top[2] > top[1] * r[2]:
                            top = r
                    best = (*top, 1000 * top[1] // top[2])
                listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
                kept = b" ".join(collapsed(words, found) if found else words)
                rows.append((len(found), *best, listed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.string()] * 3
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[x.split()[0] for x in OUTPUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUTPUT)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of each tenth document by the hash of its id, the words from some place on repeat.

    With h the CRC-32 of the id in digits, g = h div 10 and n words, word i >= a becomes word a + (i - a) mod p, where
    a = g mod n and p = 1 + (n - a) div (3 + g mod 8), if h is divisible by 10. Other texts, null ones, texts
    without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    n, a, p = F.size("_words"), F.col("_a"), F.col("_p")
    spun = (
        docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_words"))
        .withColumn("_words", F.when(n > 0, F.col("_words")))
        .withColumn("_a", (F.floor(F.col("_h") / 10) % n).cast("int"))
        .withColumn("_p", (1 + F.floor((n - a) / (3 + F.floor(F.col("_h") / 10) % 8))).cast("int"))
    )
    unit = F.slice("_words", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), a), tail), " ")
    return spun.select("doc_id", F.when(F.col("_words").isNotNull(), text).otherwise(F.col("text")).alias("text"))
