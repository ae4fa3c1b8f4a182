"""Operator 8: licence texts by Dice's coefficient over word bigrams, in DataFrame functions only.

Lines and paragraphs are normalised (lower case, ASCII other than letters and
digits becomes a space) and become sets of word bigrams. With coefficient at
least t, a set of n bigrams can only match templates of n*t/(2-t) to n*(2-t)/t
bigrams; a template outside these bounds isn't compared.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Licence notices in their usual wording (fixed values).
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}


def normalised(text: str) -> list[str]:
    return [w for w in re.sub(_OTHER, " ", text.lower()).split(" ") if w]


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8) -> DataFrame:
    """One row for each line or paragraph that matches: doc_id, unit, unit_no, licence and dice.

    unit_no counts from 0 within the text; a paragraph (parted by blank lines) is
    looked at as a whole too if it has several lines. Of several templates the
    one with the largest coefficient is given, ties by the licence's name.
    Null and empty texts, and units of fewer than two words, match nothing. A
    null doc_id is given as it is; repeated rows give repeated results; only
    doc_id and text are read.
    """
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.lit("line").alias("unit"), i.alias("unit_no"), t.alias("t")))
    blocks = F.transform(F.split("text", r"\n[\x20\x09-\x0D]*\n"), lambda t, i: F.struct(F.lit("paragraph").alias("unit"), i.alias("unit_no"), t.alias("t")))
    units = F.concat(lines, F.filter(blocks, lambda b: b["t"].contains("\n")))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.unit", "u.unit_no", "u.t")
    rows = rows.withColumn("words", F.split(F.trim(F.regexp_replace(F.lower("t"), _OTHER, " ")), " "))
    known = [(name, bigrams(normalised(t))) for name, texts in sorted((templates or TEMPLATES).items()) for t in texts]
    known = [(name, grams) for name, grams in known if grams]
    if not known:
        rows = rows.where(F.lit(False))
        known = [("", [""])]
    w = F.col("words")
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    some = F.when(F.size(w) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", "unit", "unit_no", some.alias("g")).withColumn("n", F.size("g"))
    found = []
    for name, grams in known:
        m = len(grams)
        both = F.size(F.array_intersect("g", F.array(*map(F.lit, grams))))
        fits = (F.col("n") * (2 - least) >= m * least) & (F.col("n") * least <= m * (2 - least))
        found.append(F.when(fits, F.struct((F.lit(2.0) * both / (F.col("n") + m)).alias("dice"), F.lit(name).alias("licence"))))
    best = F.aggregate(F.array_compact(F.array(*found)), F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("licence")), lambda a, x: F.when(x["dice"] > a["dice"], x).otherwise(a))
    # A filter on the coefficient would be pushed down to the text and work everything out again for each use of the bigrams.
    rows = rows.select("doc_id", "unit", "unit_no", F.explode(F.filter(F.array(best), lambda x: x["dice"] >= least)).alias("best"))
    return rows.select("doc_id", "unit", F.col("unit_no").cast("long").alias("unit_no"), F.col("best.licence").alias("licence"), F.round("best.dice", 6).alias("dice"))
