"""License scans: canonical digests of entire texts, hash-joined to those of known licences.

The canonical form drops copyright lines, lower-cases, turns typographic
quotes and dashes, ASCII punctuation and white space into single blanks, and writes
equivalent words in one way. Two texts with equal forms are one licence whatever their
layout and holder. The digest is SHA-256 of the form; the known side has one row per digest.

``unit="line"`` takes every line as an entire text, which finds notices that stand
on a line of their own.

Null texts have the form of the empty text, which is no licence. Repeated
rows are judged each. Other columns are ignored. Everything is DataFrame code: one hash join
on the digest, whose known side is unique, so a hot digest splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that licence matching treats as equal, each with the form kept.
EQUIVALENT = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"),
    ("sub license", "sublicense"), ("sub licence", "sublicense"), ("sublicence", "sublicense"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("per cent", "percent"),
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"),
    ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"),
    ("centre", "center"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("merchantability", "merchantability"), ("organisation", "organization"),
    ("organisations", "organizations"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"),
]
# Typographic marks that count as punctuation.
MARKS = "‘’‚“”„«»–—―…•©®™ "
COPYRIGHT_LINES = r"(?m)^[^a-z0-9\n]*(\(c\)|©|copyright([^a-z\n]+\(c\)|[^a-z\n]+©|[^a-z\n]*[0-9]{4})|all rights reserved)[^\n]*$"
BLANKS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f" + MARKS + "]+"
WORD = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f" + MARKS + "]+"

# Finds any of the words that are replaced, as they stand in a form.
_OLD = sorted(old.replace(" ", "  ") for old, new in EQUIVALENT if old != new)
ANY_EQUIVALENT = " (?:%s) " % "|".join(
    f"{letter}(?:{'|'.join(old[1:] for old in _OLD if old[0] == letter)})" for letter in sorted({old[0] for old in _OLD})
)

# Notices of one line and short licences, by their common names.
PERMISSION = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS "
    'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
KNOWN = [
    ("MIT", "MIT License\n\n" + MIT_BODY),
    ("MIT", MIT_BODY),
    ("ISC", f"{PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies.\n{AS_IS}"),
    ("0BSD", f"{PERMISSION}.\n{AS_IS}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
]


def canonical(text: Column) -> Column:
    """The form in which equal licences are equal texts."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINES, "")
    text = F.regexp_replace(text, BLANKS, "  ")
    # Every word has two blanks on either side, so neighbours are replaced alike.
    text = F.concat(F.lit("  "), text, F.lit("  "))
    # One search tells whether any word has to be replaced; the lambda keeps the text from being made twice.
    return F.transform(F.array(text), lambda t: F.trim(F.replace(F.when(F.rlike(t, F.lit(ANY_EQUIVALENT)), in_one_way(t)).otherwise(t), F.lit("  "), F.lit(" "))))[0]


def in_one_way(text: Column) -> Column:
    """Equivalent words written alike, one after the other."""
    for old, new in EQUIVALENT:
        if old != new:
            text = F.replace(text, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return text


def digest(text: Column) -> Column:
    """Never null, also to Spark, which would test it for null, and so make it, before a join picks the rows."""
    return F.coalesce(F.sha2(canonical(text), 256), F.lit(""))


def known_digests(known: DataFrame, name_col: str = "license", text_col: str = "text") -> DataFrame:
    """``digest``, ``license`` and the ``first`` word of the form, one row per digest; of several names the first in order."""
    rows = known.select(canonical(F.col(text_col)).alias("form"), F.col(name_col).alias("license")).where("form != ''")
    rows = rows.select(F.sha2("form", 256).alias("digest"), "license", F.split("form", " ")[0].alias("first"))
    return rows.groupBy("digest", "first").agg(F.min("license").alias("license"))


def first_word(text: Column) -> Column:
    """The first word of a text in lower case, empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(text), WORD, 0), F.lit(""))


def first_spellings(known: DataFrame) -> DataFrame:
    """``first``: every first word that a text of a known form can have, before its words are written in one way."""
    turns: dict[str, set[str]] = {}
    for old, new in EQUIVALENT:
        turns.setdefault(old.split()[0], set()).add(new.split()[0])
    spelled: dict[str, list[str]] = {}
    for old in turns:
        # Spellings of spellings count too.
        reached, fresh = {old}, {old}
        while fresh:
            fresh = {n for word in fresh for n in turns.get(word, ())} - reached
            reached |= fresh
        for new in reached - {old}:
            spelled.setdefault(new, []).append(old)
    listed = F.create_map(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for pair in sorted(spelled.items()) for v in pair])
    others = F.coalesce(F.try_element_at(listed, F.col("first")), F.array().cast("array<string>"))
    return known.select(F.explode(F.concat(F.array("first"), others)).alias("first")).distinct()


def scan(texts: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, ``digest`` and ``license`` (null if unknown). ``known`` is from ``known_digests``."""
    rows = texts.select(F.col(id_col), digest(F.col(text_col).cast("string")).alias("digest"))
    return rows.join(known.select("digest", "license"), "digest", "left").select(id_col, "digest", "license")


def scan_lines(texts: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that are a known licence or notice as a whole: id, ``line`` (from 1) and ``license``."""
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    rows = texts.select(F.col(id_col), F.posexplode(lines).alias("line", "content"))
    # A line can only be known if its first word is. The known side is small, so lines do not travel.
    firsts = F.broadcast(first_spellings(known))
    rows = rows.withColumn("first", first_word(F.col("content"))).join(firsts, "first", "left_semi")
    rows = rows.select(id_col, (F.col("line") + 1).cast("long").alias("line"), digest(F.col("content")).alias("digest"))
    return rows.join(known.select("digest", "license"), "digest").select(id_col, "line", "license")
