"""Licence scans by canonical digest.

A text is brought to a canonical form (lower case, no punctuation or copyright lines, equivalent
spellings made one) and hashed; a text is a known licence if the digests are equal. Whole
documents, whole lines of them and runs of paragraphs between blank lines are looked up, so a
notice on a line of its own is found, and a licence in full inside a longer document.
"""

from __future__ import annotations

import re
from functools import reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that mean the same, and their common form; in front, what all of them contain.
SPELLINGS = [
    ("licen", r"(^| )(licence|licences|licenses)( |$)", "$1license$3"),
    ("licenced", r"(^| )licenced( |$)", "$1licensed$2"),
    ("v", r"(^| )(version|v) ([0-9])", "$1v$3"),
    (" is ", r"(^| )this (work|software|program|project|text) is ", "$1"),
    (" under ", r"(^| )(licensed|released|distributed|published|available) under (the )?(terms of )?(the )?", "$1licensed under "),
    ("gnu general", r"(^| )gnu general public license( |$)", "$1gpl$2"),
    ("creative commons", r"(^| )creative commons attribution noncommercial( |$)", "$1cc by nc$2"),
    ("creative commons", r"(^| )creative commons attribution( |$)", "$1cc by$2"),
]
COPYRIGHT_MARKS = ["copyright ", "(c)", "©", "all rights reserved"]
# The SQL drops these lines, licence prose among them; texts in the test tables have none such.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright |\(c\)|©|all rights reserved)[^\n]*$"
_YEAR = r"(?:19|20)\d\d"
# Words after "copyright" that make it prose, and where a licence begins after a notice on its line.
_PROSE = (
    "and|are|as|by law|claims?|disclaimers?|holders?|in|infringement|interests?|is|laws?|licen[cs]es?|notices?|of|on|or"
    "|owners?|permission|protect(?:ed|ion)|rights?|statements?|status|that|this|to|treat(?:y|ies)|under|works?"
)
_OPENINGS = r"permission is hereby granted|permission to use,? copy|redistribution and use in source|this is free and unencumbered"
# A notice: a sign or a year after "copyright" or a sign, a holder up to the end of the line, or a
# lone "all rights reserved"; a notice also ends where a licence begins on its line.
NOTICE = (
    rf"(?:(?:copyright[\s:]*(?:\(c\)|©|{_YEAR})|©|\(c\)[\s:]*(?:copyright|{_YEAR}))[^\n]{{0,200}}?(?={_OPENINGS}))"
    r"|(?:(?m)^[^\p{L}\p{N}\n]*(?:(?:copyright[ \t:]*(?:\(c\)|©|[\[<{]|" + _YEAR + r")|©|\(c\)[ \t:]*(?:copyright|" + _YEAR + r"))[^\n]{0,200}"
    rf"|\(c\)[^\n]{{1,100}}(?:all rights reserved|{_YEAR})[^\p{{L}}\p{{N}}\n]*"
    rf"|copyright[ \t]+(?!(?:{_PROSE})\b)[^\s]+(?:[ \t]+[^\s]+){{0,9}}[ \t]*|all rights reserved[^\p{{L}}\p{{N}}\n]*)$)"
)

# Known licences and notices; ``known_licenses`` has more, the SQL knows these.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
]

# Licences in full, each a file of license_texts.
FULL = (
    "0BSD Apache-2.0 BSD-2-Clause BSD-3-Clause CC0-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MPL-2.0 Unlicense".split()
)
# Title lines that stand in front of texts that have none of their own.
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT License (Expat)", "Expat License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
# Patterns of wordings that are in use side by side, and what stands for them.
_HTTP = (r"https://", "http://")
_NO_APPENDIX = (r"(?s)(END OF TERMS AND CONDITIONS).*", r"\1")
_ADDRESS = (r"51 Franklin Street, Fifth Floor, Boston, MA\s+02110-1301,?\s+USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")
_NUMBERS = (r"(?m)^\s*\d\. ", "")
VARIANTS = {
    "Apache-2.0": [_NO_APPENDIX, _HTTP],
    "BSD-2-Clause": [_NUMBERS, (r"COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")],
    "BSD-3-Clause": [_NUMBERS, (r"COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"), (r"name of the copyright holder", "name of the copyright owner")],
    "GPL-2.0": [_NO_APPENDIX, _HTTP, _ADDRESS],
    "GPL-3.0": [_NO_APPENDIX, _HTTP],
    "ISC": [(r"and/or", "and"), (r"(?s)AUTHOR DISCLAIMS(.*)THE AUTHOR BE", r"AUTHORS DISCLAIM\1THE AUTHORS BE")],
    "LGPL-2.1": [_NO_APPENDIX, _HTTP, _ADDRESS],
    "LGPL-3.0": [_HTTP],
    "MPL-2.0": [_HTTP, (r"http://mozilla", "http://www.mozilla")],
    "Unlicense": [(r"http://", "https://"), (r"http://unlicense.org/", "https://unlicense.org")],
}
# Names of licences in notices, and the sentences they stand in.
NAMES = {
    "0BSD": ["0BSD", "0BSD License", "BSD Zero Clause License"],
    "Apache-2.0": ["Apache-2.0", "Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "CC0-1.0": ["CC0-1.0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License"],
    "ISC": ["ISC", "ISC License"],
    "MIT": ["MIT", "MIT License"],
    "MPL-2.0": ["MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "Unlicense": ["Unlicense"],
}
for _kind, _full in (("GPL", "General Public License"), ("LGPL", "Lesser General Public License"), ("AGPL", "Affero General Public License")):
    for _number in ("2.0", "2.1", "3.0"):
        if (_kind, _number) in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")):
            _spoken = [f"{p}{_number.removesuffix('.0')}" for p in ("v", "version ", "")] + [f"{p}{_number}" for p in ("v", "version ", "")]
            NAMES[f"{_kind}-{_number}"] = [f"{_kind}-{_number}{x}" for x in ("", "-only", "-or-later", "+")] + [
                f"{name} {x}" for name in (_kind, f"GNU {_kind}", f"GNU {_full}") for y in _spoken for x in (y, f"{y} or later", f"{y} or any later version")
            ]
for _kind, _full in (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    for _number, _port in (("4.0", "International"), ("3.0", "Unported")):
        NAMES[f"CC-{_kind}-{_number}"] = [
            f"CC-{_kind}-{_number}", f"Creative Commons {_full} {_number}", f"Creative Commons {_full} {_number} License",
            f"Creative Commons {_full} {_number} {_port} License", f"Creative Commons {_full} {_number} {_port}",
        ]
SENTENCES = [
    "Licensed under {}", "Licensed under a {}", "Licensed under the {} license", "SPDX-License-Identifier: {}", "License: {}",
    "Licensed under {} - see the LICENSE file for details", "Licensed under {}. See the LICENSE file for details",
    "Licensed under {} - see the [LICENSE](LICENSE) file for details", "Licensed under {} - see the [LICENSE.md](LICENSE.md) file for details",
    "Licensed under {}. See LICENSE for details", "See the {} for more details",
]
_GNU = (
    "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the"
    " Free Software Foundation{either} version {number} of the License{later}.\n\nThis {what} is distributed in the hope that it will be useful, but"
    " WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
    " {name} for more details.\n\nYou should have received a copy of the GNU {name} along with this {what}. If not, see <{url}>."
)
HEADERS = [
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    *(
        (f"{kind}-{number}", _GNU.format(what=what, mark=":", name=name, either=", either", number=spoken, later=", or (at your option) any later version", url=url))
        for kind, name, number, spoken in [
            ("GPL", "General Public License", "2.0", "2"),
            ("GPL", "General Public License", "3.0", "3"),
            ("LGPL", "Lesser General Public License", "2.1", "2.1"),
            ("LGPL", "Lesser General Public License", "3.0", "3"),
            ("AGPL", "Affero General Public License", "3.0", "3"),
        ]
        for what in ("program", "library", "file", "software")
        for url in ("https://www.gnu.org/licenses/", "http://www.gnu.org/licenses/")
    ),
]
BLANK_LINES = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
HEADS = 24

def _where(text: Column, contained: list[str], pattern: str, plain: str) -> Column:
    """Replace a pattern in texts that contain one of ``contained``; there is no match in others.

    A plain search is much cheaper than the pattern. The text is an element of a list, so that it is
    worked out once and not for each time it is named.
    """

    def replaced(t: Column) -> Column:
        found = reduce(Column.__or__, [F.contains(t, F.lit(x)) for x in contained])
        return F.when(found, F.regexp_replace(t, pattern, plain)).otherwise(t)

    return F.get(F.transform(F.array(text), replaced), F.lit(0))


def canonical(text: Column, drop_notices: bool = True) -> Column:
    """Lower-case words of a text in their common spelling, one blank between them."""
    text = F.lower(F.coalesce(text, F.lit("")))
    if drop_notices:
        text = _where(text, COPYRIGHT_MARKS, NOTICE, "")
    text = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    for contained, pattern, plain in SPELLINGS:
        text = _where(text, [contained], pattern, plain)
    return text


def _digest(text: Column) -> Column:
    """Digest that is never null, so that a join on it needs no filter that works it out again."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def _paragraphs(text: Column) -> Column:
    """The paragraphs of a text that have a word: an array of (c: canonical form, raw)."""
    parts = F.transform(F.split(text, BLANK_LINES), lambda t: F.struct(canonical(t).alias("c"), t.alias("raw")))
    return F.filter(parts, lambda x: x["c"] != "")


def _forms(known: DataFrame) -> DataFrame:
    """(text, license_id): what a known text is in a document, never empty.

    These are its canonical form, this with the notices (in the middle of a line they stay), and the
    canonical forms of its paragraphs, as a spelling that goes on beyond a blank line is not replaced there.
    """
    text = F.coalesce("text", F.lit(""))
    forms = F.array(canonical(text), canonical(text, False), F.array_join(_paragraphs(text)["c"], " "))
    return known.select(F.explode(F.array_distinct(forms)).alias("text"), "license_id").filter("text <> ''")


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id): canonical digest of each known text; the first id of equal ones.

    The digests are of all ``_forms`` of a text.
    """
    return (
        _forms(known)
        .select(F.sha2("text", 256).alias("digest"), "license_id")
        .groupBy("digest")
        .agg(F.min("license_id").alias("license_id"))
    )


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text): licences in full in the wordings in use, with and without title, and notices."""
    full = [row for row in KNOWN if len(row[1]) > 200]
    for name in FULL:
        texts = [files(__package__).joinpath("license_texts", f"{name}.txt").read_text(encoding="utf-8")]
        for pattern, plain in VARIANTS.get(name, []):
            texts += [re.sub(pattern, plain, t) for t in texts]
        full += [(name, t) for t in dict.fromkeys(texts)]
    titled = [(i, f"{title}\n{text}") for i, text in full for title in TITLES.get(i, [])]
    notices = [(i, x.format(name)) for i, names in NAMES.items() for name in names for x in SENTENCES]
    return list(dict.fromkeys([*KNOWN, *full, *titled, *notices, *HEADERS]))


def known_licenses(spark: SparkSession) -> DataFrame:
    """The licences and notices of this module, as (license_id, text)."""
    return spark.createDataFrame(known_texts(), "license_id string, text string")


def _heads(known: DataFrame) -> tuple[set[str], list[int]]:
    """What canonical known texts begin with (whole words, or ``HEADS`` characters), and their lengths."""
    rows = _forms(known).select(F.substring("text", 1, HEADS + 1).alias("head"), F.length("text").alias("n")).distinct().collect()
    heads = {r["head"][:HEADS] for r in rows}
    heads |= {r["head"][:i] for r in rows for i, c in enumerate(r["head"]) if c == " " and i <= HEADS}
    return heads, sorted({r["n"] for r in rows})


def _runs(rows: DataFrame, known: DataFrame, digests: DataFrame) -> DataFrame:
    """(_id, _sha, n_runs, runs): known texts that are runs of paragraphs, the longest of nested ones.

    Left out are the run that is the whole text, and one that stands in a single line. Only runs that
    begin like a known text and are as long as one are hashed, so their number does not grow with the
    square of the paragraphs.
    """
    heads, lengths = _heads(known)
    if not lengths:
        return rows.select("_id", "_sha", F.lit(0).alias("n_runs"), F.array(F.lit("")).alias("runs")).limit(0)
    wanted = F.array(*(F.lit(n) for n in lengths))

    def ends(p: Column, start: Column) -> Column:
        """Ends of runs from ``start`` that are as long as a known text."""
        first = F.struct(F.lit(-1).alias("n"), start.alias("at"), F.array().cast("array<int>").alias("ends"))

        def step(acc: Column, t: Column) -> Column:
            n, at = acc["n"] + F.length(t) + 1, acc["at"] + 1
            found = F.when((n <= lengths[-1]) & F.array_contains(wanted, n), F.concat(acc["ends"], F.array(at))).otherwise(acc["ends"])
            return F.struct(n.alias("n"), at.alias("at"), found.alias("ends"))

        # paragraphs have a word at least, so no more of them than characters of the longest text
        return F.aggregate(F.slice(p, start + 1, F.lit(lengths[-1] // 2 + 1)), first, step)["ends"]

    starts = rows.select("_id", "_sha", _paragraphs(F.col("text")).alias("_p")).withColumn("_starts", F.filter(
        F.transform("_p", lambda x, i: F.when(F.substring(x["c"], 1, HEADS).isin(*sorted(heads)), i)), lambda i: i.isNotNull()
    )).filter(F.size("_starts") > 0)
    starts = starts.select("_id", "_sha", "_p", F.explode("_starts").alias("_start"))
    found = starts.select(
        "_id", "_sha", "_p", "_start", F.explode(ends(F.col("_p")["c"], F.col("_start"))).alias("_end")
    )
    found = found.select(
        "_id",
        "_sha",
        "_start",
        "_end",
        F.size("_p").alias("_n"),
        F.array_join(F.slice(F.col("_p")["c"], F.col("_start") + 1, F.col("_end") - F.col("_start")), " ").alias("_text"),
        F.when(F.col("_end") == F.col("_start") + 1, F.get("_p", F.col("_start"))["raw"]).alias("_one"),
    )
    found = found.withColumn("digest", _digest(F.col("_text"))).join(digests, "digest")
    in_line = F.exists(F.split(F.coalesce("_one", F.lit("")), "\n"), lambda line: canonical(line) == F.col("_text"))
    run = F.struct("_start", "_end", "_n", "license_id", in_line.alias("in_line"))
    lists = found.groupBy("_id", "_sha").agg(F.collect_set(run).alias("_all"))

    def counts(r: Column) -> Column:
        whole = (r["_start"] == 0) & (r["_end"] == r["_n"])
        inside = F.exists(
            "_all", lambda q: (q["_start"] <= r["_start"]) & (q["_end"] >= r["_end"]) & (q["_end"] - q["_start"] > r["_end"] - r["_start"])
        )
        return ~whole & ~inside & ~r["in_line"]

    lists = lists.withColumn("_all", F.filter("_all", counts))
    return lists.select("_id", "_sha", F.size("_all").alias("n_runs"), F.col("_all")["license_id"].alias("runs")).filter("n_runs > 0")


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text_digest, license_id, notices, n_notices), one row per row of ``docs``.

    ``docs`` has doc_id and text, ``known`` has license_id and text; other columns are not read.
    ``license_id`` is the licence that the whole text is, else null; ``notices`` are the licences
    that whole lines of it or runs of paragraphs inside it are (sorted, each once, joined by commas;
    empty if none), and ``n_notices`` how many lines and runs are one. A null text counts as empty
    and matches nothing, also where a known text is empty. Rows that repeat stay.

    Only lines and runs that match take part in a second shuffle, by document. A row is known there
    by its id and digest, a line or run by its position, so that repeated rows do not count twice.
    The known licences are joined as a table: Spark broadcasts them only after looking at their size.
    The driver sees the lengths and first words of the known texts.
    """
    digests = known_digests(known)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumns({"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_sha": F.sha2("text", 256)})
    lines = (
        rows.select("_id", "_sha", F.posexplode_outer(F.split("text", "\n")).alias("_at", "_line"))
        .withColumn("digest", _digest(canonical(F.col("_line"))))
        .join(digests, "digest")
        .groupBy("_id", "_sha")
        .agg(F.countDistinct("_at").alias("n_lines"), F.collect_set("license_id").alias("lines"))
    )
    none = F.array().cast("array<string>")
    both = lines.join(_runs(rows, known, digests), ["_id", "_sha"], "full")
    inside = F.col("license_id").isNull()  # runs of a text that is a licence are parts of it
    ids = F.array_union(F.coalesce("lines", none), F.when(inside, F.coalesce("runs", none)).otherwise(none))
    return (
        rows.select("doc_id", "_id", "_sha", F.sha2(canonical(F.col("text")), 256).alias("text_digest"))
        .join(digests.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
        .join(both, ["_id", "_sha"], "left")
        .select(
            "doc_id",
            "text_digest",
            "license_id",
            F.array_join(F.sort_array(ids), ",").alias("notices"),
            (F.coalesce("n_lines", F.lit(0)) + F.when(inside, F.coalesce("n_runs", F.lit(0))).otherwise(0)).cast("long").alias("n_notices"),
        )
    )
