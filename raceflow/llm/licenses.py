"""Licence scan by canonical digest lookup.

A text is normalised (lower case, punctuation, copyright lines, equivalent
spellings, white space) and the digest of what is left is joined to the digests of
known licences, so a match means that the whole text is that licence. The scan also
looks up the single lines that speak of a licence or of rights, so that a notice in a
longer document is found by the same table.

All of it is DataFrame functions. The registry side is broadcast only if its counted
rows fit a fixed size. Null text counts as empty, empty text matches nothing; rows
repeat as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceflow.llm import common as C

#: Published licence texts and customary notices, by SPDX name.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    ),
    (
        "0BSD",
        """Copyright (C) YEAR by AUTHOR EMAIL

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Proprietary", "All rights reserved."),
)

#: Whole texts of usual licences, a file for each SPDX name.
TEXTS = Path(__file__).with_name("license_texts")
_TITLE, _END = re.compile(r"(?i)\A\s*(?:the )?[a-z0-9 -]{0,20}licen[cs]e(?: \(\w+\))?\s*\n"), re.compile(r"(?s)\A.*END OF TERMS AND CONDITIONS")


#: Usual titles of short licences besides the one that the text comes with.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT-0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "The 4-Clause BSD License", "Original BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "NCSA": ("University of Illinois/NCSA Open Source License", "NCSA License"),
    "PostgreSQL": ("PostgreSQL License", "The PostgreSQL License"),
    "X11": ("X11 License", "The X11 License"),
}


def whole_texts() -> list[tuple[str, str]]:
    """License and text of every whole licence; short ones without their title or list numbers too, long ones without their appendix too."""
    out = []
    for name, text in [*((p.stem, p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt"))), *((k, t) for k, t in KNOWN if len(t) > 500)]:
        bare = _TITLE.sub("", text) if len(text) < 4000 else text
        kinds = {text, bare, *(m[0] for m in [_END.match(text)] if m)}
        kinds |= {f"{title}\n{bare}" for title in TITLES.get(name, ())}
        if name.startswith("BSD"):
            kinds |= {re.sub(r"(?m)^[1-4]\. ", "* ", t) for t in kinds}
        out += [(name, t) for t in sorted(kinds)]
    return out


#: Equivalent spellings: (variant, kept form), applied in order to the lower-cased text.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("sublicence", "sublicense"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("non-infringement", "noninfringement"),
    ("per cent", "percent"),
    ("https://", "http://"),
)

#: Lines that name a holder, not terms: with (c) or ©, a place for a name, a name after "by", or a year; and reserved rights on a line below.
_COPYRIGHT = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|<|[0-9]|by )|\(c\)|©|copyright[ \t:,][^\n]*(19|20)[0-9][0-9])[^\n]*(\n[ \t]*all rights reserved[ \t.]*)?$"
_OTHER = r"[^a-z0-9À-ɏ]+"
#: A line can only be a notice if it names a license or rights.
_NOTICE = r"(?i)licen[sc]|rights"


def canonical(text: Column) -> Column:
    """The normal form whose digest is looked up."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, _COPYRIGHT, "")
    for variant, kept in SPELLINGS:
        out = F.replace(out, F.lit(variant), F.lit(kept))
    return F.trim(F.regexp_replace(out, _OTHER, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def registry(spark: SparkSession, known: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """license_id, digest of the known texts (KNOWN and whole_texts, if none are given), one row for each digest."""
    rows = spark.createDataFrame([tuple(x) for x in ((*KNOWN, *whole_texts()) if known is None else known)], "license_id string, text string")
    return rows.select("license_id", digest(F.col("text")).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, license_id (of the whole text, or null), notices (sorted licences of single lines) of every row."""
    side = C.small(known, 96)
    rows = C.only(docs, "doc_id", "text").withColumn("digest", digest(F.col("text")))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(_NOTICE))
    rows = rows.withColumn("digests", F.array_distinct(F.transform(lines, digest))).drop("text")
    found = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", "digests")
    keys = F.concat(F.array(F.col("digest")), F.col("digests"))
    pairs = found.select("row", "doc_id", F.col("digest").alias("whole"), F.posexplode(keys).alias("at", "digest"))
    hits = pairs.join(side, "digest", "left")
    return hits.groupBy("row", "doc_id", F.col("whole").alias("digest")).agg(
        F.max(F.when(F.col("at") == 0, F.col("license_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("at") > 0, F.col("license_id")))), ",").alias("notices"),
    ).drop("row")


def op9_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.read(spark, sf_dir, "documents"), registry(spark))


def plain_digest(text: str) -> str:
    """The digest of a known text in plain Python, for the SQL: line by line and letter by letter instead of by the patterns above."""
    lines, holder = [], False
    for line in text.lower().replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        word = line.lstrip(" \t")
        after = word[9:].lstrip(" \t")
        digits = "0123456789"
        year = any(word[i : i + 2] in ("19", "20") and word[i + 2 : i + 3] in digits and word[i + 3 : i + 4] in digits and len(word) >= i + 4 for i in range(10, len(word)))
        below = holder and word.startswith("all rights reserved") and not word[19:].strip(" \t.")
        holder = word.startswith(("(c)", "©")) or (word.startswith("copyright") and (after.startswith(("(c)", "©", "<", "by ")) or after[:1] in tuple(digits) or word[9:10] in (" ", "\t", ":", ",") and year))
        lines.append("" if holder or below else line)
    out = "\n".join(lines)
    for variant, kept in SPELLINGS:
        out = out.replace(variant, kept)
    keep = lambda c: c in "abcdefghijklmnopqrstuvwxyz0123456789" or "À" <= c <= "ɏ"
    return hashlib.sha256(" ".join("".join(c if keep(c) else " " for c in out).split()).encode()).hexdigest()


def _canonical_sql(x: str) -> str:
    x = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\\r\\n?', chr(10), 'g'), '(?m)^[ \\t]*(copyright[ \\t]*(\\(c\\)|©|<|[0-9]|by )|\\(c\\)|©|copyright[ \\t:,][^\\n]*(19|20)[0-9][0-9])[^\\n]*(\\n[ \\t]*all rights reserved[ \\t.]*)?$', '', 'g')"
    for variant, kept in SPELLINGS:
        x = f"replace({x}, '{variant}', '{kept}')"
    return f"trim(regexp_replace({x}, '[^a-z0-9À-ɏ]+', ' ', 'g'))"


_VALUES = ", ".join(f"('{k}', '{plain_digest(t)}')" for k, t in (*KNOWN, *whole_texts()))
ORACLE = f"""
WITH known AS (SELECT t.digest, min(t.name) AS license_id FROM (VALUES {_VALUES}) t(name, digest) GROUP BY 1),
d AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest, list_filter(str_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '(?i)licen[sc]|rights')) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line FROM d),
n AS (SELECT l.doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices
  FROM l JOIN known k ON sha256({_canonical_sql("l.line")}) = k.digest GROUP BY 1)
SELECT d.doc_id, d.digest, known.license_id, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN known ON d.digest = known.digest LEFT JOIN n ON n.doc_id = d.doc_id
"""
