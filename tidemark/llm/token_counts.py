"""Exact token counts of every prefix of a text, for byte-level BPE vocabularies.

A text is split into pieces (special strings, words, numbers, punctuation, white space); merges
never cross a piece. Inside a piece a dynamic program finds, for each prefix, the last token of
its encoding: the token ``t`` that ends there, such that the encoding of the rest ends in a token
after which ``t`` stays as it is. The count of a prefix is one more than the count of the rest.

A text's table holds the change of the count at each of its characters (16-bit numbers, so two
bytes a character). Its running sums are the exact counts of all prefixes; ``prefix_counts``,
``tokens_of_prefix`` and ``longest_prefix`` answer truncation and budget questions from it
without encoding again.

A worker remembers what it found for words and pieces of at most ``LONGEST`` characters, in about
``MEMORY`` bytes; then it forgets what it met longest ago. It also remembers for ``PAIRS`` pairs of
tokens whether the second stays after the first. Results do not depend on either.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.workers import kept

# The split pattern of this family of vocabularies. White space is spelled out, as
# libraries disagree on what \s is.
SPLIT = (
    r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SPACES = regex.compile(r"\p{White_Space}{2,}")
MEMORY = 256 << 20  # bytes of words and pieces that a worker remembers; more are worked out anew
LONGEST = 256  # characters of a word or piece that is remembered; longer ones are rarely met again
PAIRS = 1 << 19  # pairs of tokens that a worker remembers, about 60 MB
ENTRY = 128  # bytes that an entry takes beside its key and value


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of the vocabulary files: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class PrefixCounter:
    """The vocabulary of a tokenizer file, with what has been worked out so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        letters = _byte_letters()
        model = whole["model"]
        if model["type"] != "BPE" or whole["pre_tokenizer"]["type"] != "ByteLevel" or whole["normalizer"]:
            raise ValueError(f"{path}: not a byte-level BPE without normalizer")
        raw = {w: bytes(letters[c] for c in w) for w in model["vocab"] if all(c in letters for c in w)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(raw[a], raw[b]): i for i, (a, b) in enumerate(pairs)}
        self.by_number = [None, *dict.fromkeys(raw.values())]
        self.numbers = {token: i for i, token in enumerate(self.by_number) if i}
        self.longest = max(map(len, self.numbers))
        self.fits: dict[int, bool] = {}  # pair of tokens -> whether the second stays as it is
        special = sorted((t["content"] for t in whole.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.split = regex.compile(SPLIT).findall
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (a, b), i in self.ranks.items():
            self.made.setdefault(a + b, (i, a, b))
        self.whole: dict[bytes, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0  # bytes of both
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # pieces and words of the generation before

    def stays(self, before: bytes | None, token: bytes) -> bool:
        """Whether ``token`` is a token of its own after ``before`` (at the start: if None).

        The last merges on either side of the border are undone, the latest first; of equal ones
        the right one is later. If a merge across the border comes before the one just undone,
        the border is not there in the encoding.
        """
        ranks, made = self.ranks, self.made
        if before is None:
            if (found := self.whole.get(token)) is None:
                left, right = made[token][1:] if token in made else (None, None)
                found = left is None or (self.stays(None, left) and self._only(left, right))
                self.whole[token] = found
            return found
        limit = len(ranks)
        while True:
            if ranks.get((before, token), limit) < limit:
                return False
            a, b = made.get(before), made.get(token)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                limit, before = a[0], a[2]
            else:
                limit, token = b[0] + 1, b[1]

    def _only(self, left: bytes, right: bytes) -> bool:
        """Whether two parts come to be, side by side, before the merge that joins them."""
        limit = self.ranks[left, right]
        while True:
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]
            if self.ranks.get((left, right), limit) < limit:
                return False

    def counts(self, piece: str) -> list[int]:
        """Token count of each prefix of a piece, by characters; the empty prefix first."""
        data = piece.encode()
        number, fits, known = self.numbers.get, self.fits, len(self.numbers) + 1
        last = [0] * (len(data) + 1)  # number of the last token times ``known``; 0 at the start
        count = [0] * (len(data) + 1)
        for end in range(1, len(data) + 1):
            for start in range(end - 1, max(-1, end - self.longest - 1), -1):  # one of them fits
                token = number(data[start:end])
                if token is None:
                    continue
                pair = last[start] + token
                if (fit := fits.get(pair)) is None:
                    before = self.by_number[last[start] // known]
                    fit = self.stays(before, data[start:end])
                    if len(fits) >= PAIRS:
                        fits.clear()
                    fits[pair] = fit
                if fit:
                    last[end], count[end] = token * known, count[start] + 1
                    break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece!r}")
        if len(data) == len(piece):
            return count
        # a character ends where the next byte does not go on with it
        return [0, *(c for c, byte in zip(count[1:-1], data[1:], strict=True) if byte & 0xC0 != 0x80), count[-1]]

    def steps(self, piece: str) -> bytes:
        """Change of the count at each character of a piece, as 16-bit numbers."""
        if (found := self.pieces.get(piece)) is None:
            found = self.older[0].get(piece) or self._steps(piece)
            self._keep(piece, found, word=False)
        return found

    def _steps(self, piece: str) -> bytes:
        count = self.counts(piece)
        if len(piece) == 3 and piece[0] == "'" and piece[1:].isalpha():
            count[2] = 2  # a cut contraction is an apostrophe and a letter
        return array("h", map(sub, count[1:], count)).tobytes()

    def _keep(self, key: str, found: bytes, word: bool) -> None:
        """Remembers what was found for a key, in two generations of half of ``MEMORY`` each.

        A full generation takes the place of the one before; what is met again moves to the new one.
        """
        if len(key) > LONGEST:
            return
        size = sys.getsizeof(key) + sys.getsizeof(found) + ENTRY
        if self.held + size > MEMORY // 2:
            self.older = self.pieces, self.words
            self.pieces, self.words = {}, {}
            self.held = 0
        self.held += size
        (self.words if word else self.pieces)[key] = found

    def table(self, text: str) -> np.ndarray:
        """Change of the token count at each character of a text."""
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1:
            return self._plain(text)
        out = []
        for i, part in enumerate(parts):
            if i % 2 == 0:
                out.append(self._plain(part))
            else:  # a special string is one token; a cut one is ordinary text
                out.append(self._special(part, "".join(parts[:i])))
        return np.concatenate(out)

    def _special(self, string: str, before: str) -> np.ndarray:
        """Steps of a special string: its cut prefixes are text that goes on from what is before."""
        start = before[len(before) - len(before.split(string)[-1]) :] if string in before else before
        base = int(self._plain(start).sum())
        cut = self._plain(start + string[:-1])
        now = np.cumsum(cut, dtype=np.int64)[len(start) :] - base
        return np.diff(np.append(now, 1), prepend=0).astype(np.int16)

    def word(self, word: str) -> bytes:
        """Steps of a blank and what follows it up to the next blank: no piece crosses a blank's start."""
        if found := self.words.get(word):
            return found
        if found := self.older[1].get(word):
            pass
        elif len(pieces := self.split(" " + word)) == 1:  # remembered once, as a word
            found = self.pieces.get(pieces[0]) or self._steps(pieces[0])
        else:
            found = b"".join(map(self.steps, pieces))
        self._keep(word, found, word=True)
        return found

    def _plain(self, text: str) -> np.ndarray:
        runs = list(SPACES.finditer(text))
        if runs or not text:
            blob = b"".join(map(self.steps, self.split(text)))
        else:
            first, *words = text.split(" ")
            known, word = self.words, self.word
            blob = b"".join([*map(self.steps, self.split(first)), *(known.get(w) or word(w) for w in words)])
        steps = np.frombuffer(blob, np.int16)
        if runs:  # a prefix that ends inside a run of white space has the run so far as one piece
            steps = steps.copy()
            total = np.cumsum(steps, dtype=np.int64)
            for m in runs:
                a, b = m.span()
                now = (total[a - 1] if a else 0) + np.array(self.counts(m.group()))
                steps[a:b] = np.diff(now)
                if b < len(steps):
                    steps[b] = total[b] - now[-1]
        return steps


def _counter(path: str) -> PrefixCounter:
    return kept(("prefix counter", path), lambda: PrefixCounter(path))


def prefix_tables(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_bytes, n_chars, n_tokens, steps), one row per row of ``docs``.

    ``docs`` has doc_id and text; other columns are not read. ``vocabulary`` is the path of a
    byte-level BPE tokenizer file that each worker can open. Whole texts are counted, without
    added begin or end tokens; special strings in a text are one token. A null text counts as
    empty: no bytes, tokens or steps. Rows are independent, so nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(vocabulary)
        for batch in batches:
            tables = [counter.table(x) for x in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_bytes": batch["n_bytes"],
                    "n_chars": [len(t) for t in tables],
                    "n_tokens": [int(t.sum(dtype=np.int64)) for t in tables],
                    "steps": [t.tobytes() for t in tables],
                }
            )

    text = F.coalesce("text", F.lit(""))
    # ids travel as text: pandas would turn whole numbers beside nulls into floating ones
    return (
        docs.select(
            F.col("doc_id").cast("string").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
        )
        .mapInPandas(run, "doc_id string, n_bytes long, n_chars long, n_tokens long, steps binary")
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )


def prefix_counts(steps: bytes) -> np.ndarray:
    """Token count of each prefix of a text, from its table; the empty prefix first."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int16), dtype=np.int64)])


@F.pandas_udf(LongType())
def tokens_of_prefix(steps: pd.Series, chars: pd.Series) -> pd.Series:
    """Tokens of the first ``chars`` characters (of the whole text, where it is shorter)."""
    return pd.Series([int(prefix_counts(s)[min(max(int(c), 0), len(s) // 2)]) for s, c in zip(steps, chars, strict=True)])


@F.pandas_udf(LongType())
def longest_prefix(steps: pd.Series, budget: pd.Series) -> pd.Series:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    return pd.Series(
        [int(np.flatnonzero(prefix_counts(s) <= max(int(b), 0))[-1]) for s, b in zip(steps, budget, strict=True)]
    )
