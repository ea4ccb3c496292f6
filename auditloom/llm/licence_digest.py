"""Licence scan: canonical texts, hashed whole and joined to the digests of known licences."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and the usual one-line notices, by SPDX identifier. They are
# those of the SQL; `known_texts` and `known_notices` add the texts and names of the data files.
TEXTS = [
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
]
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

# Spellings that count as one, each pair applied to whole words of lower-case text.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("noninfringement", "non infringement"),
    ("whilst", "while"), ("favour", "favor"), ("organisation", "organization"), ("programme", "program"), ("owner", "holder"),
]


#: Titles that stand above licence texts, in canonical form.
TITLES = [
    "mit", "mit license", "mit license mit", "mit license expat", "expat license", "mit no attribution", "isc", "isc license", "isc license isc", "zlib license", "zlib libpng license",
    "bsd zero clause license", "zero clause bsd", "zero clause bsd license", "bsd 0 clause license", "0bsd", "0bsd license", "bsd license", "bsd 2 clause license", "2 clause bsd license",
    "simplified bsd license", "freebsd license", "bsd 2 clause simplified license", "bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license",
    "bsd 3 clause new or revised license", "apache license", "apache license version 2 0", "apache license version 2 0 january 2004", "version 2 0 january 2004", "http www apache org licenses",
    "https www apache org licenses", "gnu general public license", "gnu lesser general public license", "gnu library general public license", "gnu free documentation license",
    "version 1 february 1989", "version 2 june 1991", "version 3 29 june 2007", "version 2 1 february 1999", "version 1 2 november 2002", "version 1 3 3 november 2008", "mozilla public license",
    "mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license version 1 1", "version 1 1", "version 2 0", "boost software license version 1 0 august 17th 2003",
    "boost software license", "unlicense", "creative commons legal code", "cc0 1 0 universal", "sil open font license", "version 1 1 26 february 2007", "blue oak model license", "version 1 0 0",
    "do what the fuck you want to public license", "version 2 december 2004", "artistic license", "license", "licence", "copyright and permission notice",
]
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
INLINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]"
GAP = f"{INLINE}+"
TITLE = f"(?:the{GAP})?(?:" + "|".join(t.replace(" ", GAP).replace("license", "licen[sc]e") for t in sorted(TITLES, key=lambda t: (-len(t), t))) + ")"
YEAR = r"(?:(?:19|20)[0-9]{2}(?![0-9])|yyyy|year\b)"
#: A line that states a copyright. '(c)' alone may number a paragraph.
STATEMENT = rf"(?<![^\n]){INLINE}*(?:copyrights?\b{INLINE}*(?:\(c\)|©|c\b|{YEAR})|\(c\){INLINE}*(?:copyright|{YEAR})|©)[^\n]*"
#: The beginning of the first line that is no heading.
BODY_LINE = (
    rf"(?<![^\n])(?!{INLINE}*(?:(?:copyright|\(c\)|©)[^\n]*|all rights reserved{INLINE}*|{TITLE}{INLINE}*)(?:\n|\z))"
    rf"{INLINE}*+[a-z0-9\x{{80}}-\x{{10FFFF}}]"
)


def canonical(text: Column) -> Column:
    """Lower-case ASCII words with single blanks; copyright lines dropped, spellings made one. Null is empty.

    Only A-Z are lower-cased; every other character but letters, digits and code points above
    127 counts as punctuation, that is, as a blank.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = F.translate(F.coalesce(text, F.lit("")), upper, lower)
    # Lines such as "Copyright (c) 2020 A. N. Author" and "All rights reserved."
    out = F.regexp_replace(out, r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*", "$1")
    out = F.regexp_replace(out, r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(?=\n|$)", "$1")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def words(text: Column) -> Column:
    """Lower-case text as ASCII words with single blanks, spellings made one."""
    out = F.concat(F.lit(" "), F.regexp_replace(text, rf"{BREAK}+", "  "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def body(text: Column) -> Column:
    """The canonical form of a licence without what stands around it: title, holders, years. Null is empty.

    Copyright statements ('copyright' with (c), a sign or a year) go wherever they stand; lines that
    only name a holder, titles and 'all rights reserved' go before the first other line. A line
    of the body that happens to begin with 'copyright' stays, so a text has one form in any wrap.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = F.translate(F.coalesce(text, F.lit("")), upper, lower)
    out = F.regexp_replace(F.regexp_replace(out, r"\r\n?", "\n"), STATEMENT, "")
    out = words(F.regexp_replace(out, rf"(?s)\A.*?(?={BODY_LINE})", ""))
    return F.regexp_replace(F.replace(out, F.lit("https "), F.lit("http ")), rf"^(?:(?:{TITLE.replace(GAP, ' ')}) ){{1,4}}(?=.)", "")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]], form: Callable[[Column], Column] = canonical) -> DataFrame:
    """(known_digest, licence), one row a digest: as many rows as ``texts`` at most."""
    rows = spark.createDataFrame(texts, "licence string, text string")
    return rows.groupBy(F.sha2(form(F.col("text")), 256).alias("known_digest")).agg(F.min("licence").alias("licence"))


def known_texts() -> list[tuple[str, str]]:
    """TEXTS and the licence texts of the data file, some in several published forms."""
    lines = (files("auditloom.llm") / "data/licence_texts.jsonl").read_text("utf-8").split("\n")
    return TEXTS + [(row["licence"], row["text"]) for row in map(json.loads, filter(None, lines))]


#: What a notice begins with in all its wordings, in canonical form and, for the line filter, in texts.
OPENING = r"^(?:th(?:is|e) [a-z]+ is )?(?:licensed|released|distributed|(?:made )?available) under (?:the )?(?:terms of (?:the )?)?"
OPENED = r"(?:released|distributed|available)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+under"


def notice_form(text: Column) -> Column:
    """The canonical form of a line, the wordings of 'licensed under' made one."""
    return F.regexp_replace(canonical(text), OPENING, "licensed under ")


def known_notices() -> list[tuple[str, str]]:
    """NOTICES, an SPDX line for each identifier of the SPDX list, and a notice for each name of a licence."""
    names = json.loads((files("auditloom.llm") / "data/licence_names.json").read_text("utf-8"))
    tags = [(i, f"SPDX-License-Identifier: {i}") for i in names["ids"]]
    every = [(i, n) for i in names["ids"] for n in (i, f"{i} License", *names["names"].get(i, []))]
    return NOTICES + tags + [(i, f"{opening} {n}") for i, n in every for opening in ("License:", "Licensed under")]


def notice_filter(canonical_notices: list[str]) -> str:
    """A pattern that each line holds, in any spelling, whose canonical form is one of the given ones.

    Each notice has one of few chosen words; a word is looked for in all spellings made one with it.
    Words are letters, digits and code points above 127, so they need no escape.
    """
    left = [{w for w in words if len(w) > 5} or {max(words, key=len)} for words in map(str.split, canonical_notices) if words]
    chosen = []
    while left:
        counts = Counter(w for words in left for w in words)
        chosen.append(max(counts, key=lambda w: (counts[w], w)))
        left = [words for words in left if chosen[-1] not in words]
    spelt, size = set(chosen), 0
    while size != len(spelt):
        size = len(spelt)
        spelt |= {old for old, new in SPELLINGS if spelt & set(new.split())}
    if "licensed" in spelt:
        spelt.add(OPENED)
    least = sorted(w for w in spelt if not any(v != w and v in w for v in spelt))
    return "(?i)" + "|".join(least) if least else r"(?!)"


def scan(
    docs: DataFrame, texts: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Per row of ``docs``: doc_id, canon_sha256, licence, n_notices, notices.

    ``licence`` is that of the known text whose digest equals the digest of the whole canonical
    text, or else that of the known text with the same `body`, or null. ``notices`` names, sorted and joined by commas, the licences of lines that
    are known one-line notices; ``n_notices`` counts such lines. A null text counts as empty and
    matches nothing; repeated rows are scanned each; other columns are not used; long texts are
    read whole; an empty table gives an empty table. ``texts`` and
    ``notices`` are by default `known_texts` and `known_notices`.
    """
    spark = docs.sparkSession
    texts = known_texts() if texts is None else texts
    notices = known_notices() if notices is None else notices
    # As many rows as the fixed lists at most.
    whole = F.broadcast(known(spark, texts + notices))
    bodies = F.broadcast(known(spark, texts, body).where(F.col("known_digest") != F.sha2(F.lit(""), 256)).select(
        F.col("known_digest").alias("known_body"), F.col("licence").alias("body_licence")))
    lines = spark.createDataFrame(notices, "licence string, text string").select("licence", notice_form(F.col("text")).alias("form"))
    # By the first digits, then by the digest, so that a look-up reads few entries of the map.
    table = {}
    forms = lines.where("form <> ''").groupBy("form").agg(F.min("licence").alias("licence")).collect()
    for form, licence in forms:
        key = hashlib.sha256(form.encode()).hexdigest()
        table.setdefault(key[:3], {})[key] = licence
    table = F.from_json(F.lit(json.dumps(table)), "map<string,map<string,string>>")
    pattern = notice_filter([form for form, _ in forms])
    keys = F.transform(
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(pattern))), lambda x: F.sha2(notice_form(x), 256))
    named = F.filter(F.transform(keys, lambda x: F.try_element_at(F.try_element_at(table, F.left(x, F.lit(3))), x)), lambda x: x.isNotNull())
    out = docs.select("doc_id", digest(F.col("text")).alias("canon_sha256"), F.sha2(body(F.col("text")), 256).alias("body"), named.alias("named"))
    out = out.join(whole, F.col("canon_sha256") == F.col("known_digest"), "left").join(bodies, F.col("body") == F.col("known_body"), "left")
    return out.select(
        "doc_id", "canon_sha256", F.coalesce("licence", "body_licence").alias("licence"), F.size("named").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("named")), ",").alias("notices"),
    )
