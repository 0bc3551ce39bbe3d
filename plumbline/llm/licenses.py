"""License scans: a trained classifier of paragraphs, confirmed by templates. JVM-side throughout.

A paragraph is a line that isn't blank; of a hard-wrapped licence each line is judged. Paragraphs
that hold an anchor word or share a word 2-gram with some template are candidates. Candidates
that are like enough to a template of any family, the rest of which no family could confirm, are
classified: their word 1- to 3-grams are counted over the training vocabulary, and a multinomial
logistic regression gives each licence family and ``unknown`` a probability. Training texts are the
templates under fixed rewordings, and their lines when wrapped; unknown ones are sentences that use the same words without
granting a licence. Probabilities are calibrated by a temperature. It is chosen on templates that
training did not see: each third of them is judged by a model of the other two. A family stands if
it is likely enough and the paragraph shares most of its 2-grams with one of the family's
templates, or holds most of a template's.
"""

from __future__ import annotations

import math
import re

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, NGram, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import _runtime as R

UNKNOWN = "unknown"
LIKELY, ALIKE = 0.5, 0.6
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)
FOLDS = 3
#: Words of a line of a hard-wrapped licence in training.
LINE = 10

# Statements by which texts declare a licence, by family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is distributed under the terms of the Apache License 2.0.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "Distributed under the GPL v2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "Distributed under the GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.", "Distributed under the terms of the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "Distributed under the terms of the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Licensed under the simplified BSD license.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"),
    "EPL-2.0": ("Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "This work is dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"),
    "Proprietary": ("All rights reserved.", "Copyright by the author. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the publisher."),
}
# Sentences with the same words that grant nothing.
OTHER = (
    "The driver lost the licence after the accident.", "A license to kill is the title of a film.", "You need permission to enter the garden.",
    "The museum reserved all rights seats for members.", "The public domain of science is a matter of debate.", "He published the source of the river.",
    "The general public was free to visit the work.", "The terms of the contract were met.", "Version 2.0 of the report is out.", "The apache tribe lived in the south.",
    "Copyright law differs between countries.", "She asked for written permission to leave.", "Creative work is common in this school.", "The commons were open to all.",
    "A fishing license is required at the lake.", "The warranty on the car expired.", "They modified the form under pressure.", "Distribution of food was free of charge.",
    "MIT is a university in Cambridge.", "The foundation published a code of conduct.", "The court revoked the bar's liquor license.", "This file is not available.", "The work is done and the use of it is free.",
    "All members reserved their rights to appeal.", "Redistribution of wealth is a political issue.", "The library lent the book to the public.", "The software was free but not good.",
    "Anyone is free to use the garden for any purpose.", "The notice appeared in all copies of the newspaper.", "The conditions of the road were met with concern.", "Neither the name of the ship nor the names of its crew were known.", "You should have received a letter along with this parcel.",
    "The list of conditions hung on the wall of the lobby.", "They obtained a copy of the letter and filed it.", "Either version of the story may be true, or neither.", "The terms of the peace were published by the crown.", "A public license plate was found at the station.",
    "Without any warranty of truth he told the tale.", "The author dedicated the work to a friend.", "The code of the safe was written on a form.", "It is subject to the weather and to the terms of the harbour.", "The eclipse was public and free to watch.",
)
#: Rewordings of a statement.
FORMS = ("{}", "{} ", "Note: {}", "{} See the file for details.", "This text: {}", "(c) the authors. {}", "{} Please keep this notice.", "Notice. {}", "{} Copies are welcome.", "As stated before, {}")
#: Words that speak of licences. A paragraph with one is a candidate even if it shares no 2-gram.
ANCHOR = r"(?i)licen[cs]e|unlicense|copyright|permission|permitted|rights|gpl|cc0|public domain"


def words(text: Column) -> Column:
    """A-Z lower-cased runs of letters, digits and inner dots or dashes."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"), F.lit(0))


def pairs(tokens: Column) -> Column:
    """Distinct 2-grams; the word itself where there is one."""
    two = F.transform(tokens, lambda x, i: F.concat(x, F.lit(" "), F.get(tokens, i + 1)))  # null behind the last word
    return F.array_distinct(F.when(F.size(tokens) > 1, F.slice(two, 1, F.greatest(F.size(tokens) - 1, F.lit(1)))).otherwise(tokens))


def literal_pairs(text: str) -> list[str]:
    """``pairs`` of a template's words, for an array of literals: Spark folds no lambda over one."""
    tokens = re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", "".join(c.lower() if c.isascii() else c for c in text))
    return list(dict.fromkeys(" ".join(tokens[i : i + 2]) for i in range(max(len(tokens) - 1, min(len(tokens), 1)))))


def lines_of(text: str) -> list[str]:
    """The lines of a long statement as a file of short lines would wrap it, twice, at other places."""
    tokens = text.split()
    return [" ".join(tokens[i : i + LINE]) for first in (0, LINE // 2) for i in range(first, len(tokens) - LINE // 2, LINE)] if len(tokens) > LINE + 4 else []


def statements() -> list[tuple[str, str, int]]:
    """(text, family, fold) of the training texts; rewordings and lines of a text are in one fold."""
    every = [(t, family, i % FOLDS) for family, texts in {**TEMPLATES, UNKNOWN: OTHER}.items() for i, t in enumerate(texts)]
    return [(f.format(t), family, k) for t, family, k in every for f in FORMS] + [(x, family, k) for t, family, k in every for x in lines_of(t)]


class Model:
    """A trained classifier."""

    def __init__(self, rows: DataFrame):
        grams = [NGram(n=n, inputCol="words", outputCol=f"g{n}") for n in (1, 2, 3)]
        counts = [CountVectorizer(inputCol=f"g{n}", outputCol=f"c{n}", binary=True) for n in (1, 2, 3)]
        label = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep")
        steps = [*grams, *counts, VectorAssembler(inputCols=["c1", "c2", "c3"], outputCol="features"), label, LogisticRegression(family="multinomial", regParam=0.003, maxIter=30)]
        rows = rows.cache()
        self.model = Pipeline(stages=steps).fit(rows)
        rows.unpersist()
        self.families = self.model.stages[-2].labels

    def margins(self, rows: DataFrame) -> DataFrame:
        """``rows`` (words) with the margin of each family."""
        model = self.model.copy()
        model.stages = [s for s in self.model.stages if not isinstance(s, type(self.model.stages[-2]))]
        out = model.transform(rows)
        return out.select(*rows.columns, F.slice(vector_to_array("rawPrediction"), 1, len(self.families)).alias("margins"))


def soft(margins: Column, temperature: float) -> Column:
    top = F.array_max(margins)
    e = F.transform(margins, lambda x: F.exp((x - top) / F.lit(temperature)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


class Scanner:
    """The model of all templates, and the temperature of templates that a model did not see."""

    def __init__(self, spark: SparkSession):
        data = spark.createDataFrame(statements(), "text string, family string, fold int").withColumn("words", words(F.col("text"))).coalesce(1)
        held = None
        for k in range(FOLDS):
            model = Model(data.where(F.col("fold") != k))
            own = F.array_position(F.array(*map(F.lit, model.families)), F.col("family")).cast("int")
            rows = model.margins(data.where(F.col("fold") == k)).select("text", "family", "margins", own.alias("own"), F.lit(k).alias("fold"), F.array(*map(F.lit, model.families)).alias("families"))
            held = rows if held is None else held.unionByName(rows)
        #: Unseen statements with their margins: (text, family, margins, own, fold, families).
        self.unseen = R.written(held.where("own > 0"), "unseen")
        chance = lambda t: F.greatest(F.element_at(soft(F.col("margins"), t), F.col("own")), F.lit(1e-12))
        loss = self.unseen.agg(*[(-F.avg(F.log(chance(t)))).alias(str(i)) for i, t in enumerate(TEMPERATURES)]).first()
        self.temperature = min((x if x is not None else math.inf, t) for x, t in zip(loss, TEMPERATURES, strict=True))[1]
        self.model = Model(data)
        self.families = self.model.families

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` (words) with the likeliest family and its chance."""
        return likeliest(self.model.margins(rows), F.array(*map(F.lit, self.families)), self.temperature)


def likeliest(rows: DataFrame, families: Column, temperature: float) -> DataFrame:
    out = rows.withColumn("chances", soft(F.col("margins"), temperature)).drop("margins")
    best = F.array_max("chances")
    return out.withColumns({"likely": F.element_at(families, F.array_position("chances", best).cast("int")), "chance": best}).drop("chances")


_scanners: dict[str, Scanner] = {}


def scanner(spark: SparkSession) -> Scanner:
    """The session's scanner. Templates are fixed, so it is trained once."""
    key = spark.sparkContext.applicationId
    if key not in _scanners:
        _scanners[key] = Scanner(spark)
    return _scanners[key]


def shares(size: Column, shared: Column, texts) -> Column:
    """Greatest share of 2-grams that a paragraph and one of ``texts`` have in common: of the
    paragraph's or of the template's, whichever is more. ``size`` counts the paragraph's 2-grams,
    ``shared`` has at least those of them that are in ``texts``. Templates are literals."""
    def share(two: list[str]) -> Column:
        both = F.size(F.filter(shared, lambda x: x.isin(two))).cast("double")
        return F.greatest(both / len(two), F.when(size >= 3, both / size).otherwise(F.lit(0.0)))

    return F.greatest(*[share(literal_pairs(t)) for t in texts], F.lit(0.0))


def alike(family: Column, tokens: Column) -> Column:
    """``shares`` with the templates of the family; 0 of an unknown one."""
    own = pairs(tokens)
    out = F.lit(0.0)
    for name, texts in TEMPLATES.items():
        out = F.when(family == name, shares(F.size(own), own, texts)).otherwise(out)
    return out


def candidates(lines: Column, similar: float) -> Column:
    """(line, paragraph, near) of lines that hold an anchor or share a 2-gram with a template.
    ``near`` are those that are like enough to one of all templates, as a statement must be."""
    every = {t: literal_pairs(t) for texts in TEMPLATES.values() for t in texts}
    known = sorted({x for two in every.values() for x in two})
    # what a similar line must share: three 2-grams, most of its own, or one of a template so short that two suffice
    short = sorted({x for two in every.values() if len(two) * similar <= 2 for x in two})
    # a transform for each value that is used twice, so that none is worked out again
    out = F.transform(lines, lambda x, n: F.struct(n.alias("line"), x.alias("paragraph"), words(x).alias("words")))
    out = F.transform(out, lambda p: F.struct(p["line"].alias("line"), p["paragraph"].alias("paragraph"), pairs(p["words"]).alias("own")))
    out = F.transform(out, lambda p: F.struct(p["line"].alias("line"), p["paragraph"].alias("paragraph"), F.size(p["own"]).alias("size"), F.filter(p["own"], lambda x: x.isin(known)).alias("shared")))
    out = F.filter(out, lambda p: (F.size(p["shared"]) > 0) | F.regexp_like(p["paragraph"], F.lit(ANCHOR)))
    may = lambda p: (F.size(p["shared"]) >= 3) | ((p["size"] >= 3) & (F.size(p["shared"]) >= similar * p["size"])) | F.exists(p["shared"], lambda x: x.isin(short))
    near = lambda p: F.when(may(p), shares(p["size"], p["shared"], every) >= similar).otherwise(similar <= 0)
    return F.transform(out, lambda p: F.struct(p["line"].alias("line"), p["paragraph"].alias("paragraph"), near(p).alias("near")))


def scan(documents: DataFrame, likely: float = LIKELY, similar: float = ALIKE) -> DataFrame:
    """A row per row of ``documents``: doc_id, n_paragraphs, licenses, n_unknown, statements.

    Paragraphs are lines that aren't blank. ``statements`` lists the confirmed ones in order
    (line from 0, family, chance, similarity), ``licenses`` their families, sorted; ``n_unknown``
    counts candidates that no template confirms, classified or not. A null or empty text has no paragraphs; rows
    without doc_id and repeated rows are each scanned. Equal paragraphs are classified once.
    """
    spark = documents.sparkSession
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    blank = lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c")) == ""
    rows = documents.select("doc_id", F.size(F.filter(lines, lambda x: ~blank(x))).cast("long").alias("n_paragraphs"), candidates(lines, similar).alias("found"))
    hits = F.transform(F.filter("found", lambda p: p["near"]), lambda p: F.struct(p["line"].alias("line"), p["paragraph"].alias("paragraph")))
    rows = rows.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_candidates"), hits.alias("hits"))
    rows = R.written(rows.withColumn("row", F.monotonically_increasing_id()), "paragraphs")
    listed = rows.select("row", F.explode("hits").alias("hit")).select("row", "hit.line", F.col("hit.paragraph").alias("text"))
    distinct = listed.select("text").distinct().withColumn("words", words(F.col("text")))
    judged = scanner(spark).probabilities(distinct)
    judged = judged.withColumn("similarity", alike(F.col("likely"), F.col("words")))
    stands = (F.col("likely") != UNKNOWN) & (F.col("chance") >= likely) & (F.col("similarity") >= similar)
    judged = R.written(judged.select("text", F.when(stands, F.col("likely")).alias("family"), "chance", "similarity"), "judged")
    found = listed.join(judged, "text").groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("family").isNotNull(), F.struct("line", "family", "chance", "similarity")))).alias("statements"),
    )
    out = rows.select("row", "doc_id", "n_paragraphs", "n_candidates").join(found, "row", "left")
    none = F.array().cast("array<struct<line:int,family:string,chance:double,similarity:double>>")
    out = out.withColumn("statements", F.coalesce("statements", none))
    return out.select("doc_id", "n_paragraphs", F.array_sort(F.array_distinct(F.transform("statements", lambda s: s["family"]))).alias("licenses"), (F.col("n_candidates") - F.size("statements")).alias("n_unknown"), "statements")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence families of all documents."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_paragraphs", F.array_join("licenses", ",").alias("licenses"), F.size("statements").cast("long").alias("n_statements"), "n_unknown")
