"""Licence scans: a trained paragraph classifier, applied with DataFrame functions only.

A multinomial logistic regression with an L1 penalty is fitted on the driver on the fixed templates below, long and short,
on windows of them, and on unknowns: notices of other licences and sentences that only sound alike. Its probabilities are
scaled on other sentences, of families and unknown, of which the fit has none. Its features are the word 1- to 3-grams of
paragraphs that hold a word of licences or the name of a family; a paragraph without one is unknown by definition and is
passed over by one pattern in the scan. The weights, a table whose size the templates fix, are joined to the n-grams of the remaining paragraphs; summed scores
give a family or "unknown". A family counts as confirmed when the paragraph holds enough of the words of one sentence of
that family's templates.

A paragraph is a line of the text that is not blank, or a run of such lines read as one, so that hard-wrapped text is
found too; its number is that of its (first) line. A line is compared by words, a run by its 3-grams of words; a run
gives way where a line of it is already confirmed as the same family. A paragraph has one family: the likeliest, or that of the template sentence that a
run holds most of.
Nulls and empty texts have no paragraphs and no licences. Equal
scores go to the family first in the alphabet. Repeated rows repeat, each with its own result; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

UNKNOWN = "unknown"
#: The openings and notices of public licences, by family.
TEMPLATES = {
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Released under the BSD License.", "Distributed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["Licensed under CC0 1.0.", "This work is released under the CC0 1.0 Universal Public Domain Dedication license.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GPL license, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "either version 3 of the License, or any later version", "Released under the GPL license, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain under the Unlicense license.", "SPDX-License-Identifier: Unlicense"],
}
#: Sentences with licence words that name no licence.
OTHERS = [
    "She showed her driver license to the officer at the gate.", "The restaurant lost its liquor license last year.", "The warranty covers parts and labour for two years.",
    "All copyright in the photographs remains with the museum.", "He licensed the song to a film studio.", "Redistribution of wealth was the subject of the debate.",
    "The licence fee is paid each year by every household.", "A fishing license costs ten dollars.", "Permission was granted to build the bridge.", "No warranty is given for the used car.",
    "The doctor is licensed to practise in three states.", "Copyright law protects authors.", "Under the terms of the treaty both sides agreed to a truce.", "Plates and license numbers were recorded.",
    "The software license server is down again.", "Please read the license before you install version 3 of the program.", "The apache helicopter is licensed for export.",
    "The public license office opens at nine, version 2 of the form is on the desk.", "Our attribution model was licensed from a vendor.", "Licensed under a secret agreement.", "This work is licensed under terms that are not public.",
]
#: Short forms of the families' names, as titles and notices print them.
SHORT = {
    "agpl-3.0": ["GNU Affero General Public License v3.0", "AGPLv3"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "license: Apache-2.0"],
    "bsd": ["BSD 3-Clause License", "The 2-Clause BSD License", "license: BSD"],
    "cc-by": ["Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International"],
    "cc0": ["CC0 1.0 Universal"],
    "gpl-2.0": ["GNU General Public License v2.0", "GNU GPL v2", "GPLv2 or later", "GPLv2"],
    "gpl-3.0": ["GNU General Public License v3.0", "GNU GPL v3", "GPLv3 or later", "GPLv3"],
    "lgpl": ["GNU Lesser General Public License v2.1", "GNU LGPL", "LGPLv3"],
    "mit": ["The MIT License (MIT)", "MIT License", "license: MIT"],
    "mpl-2.0": ["Mozilla Public License Version 2.0", "MPL 2.0"],
    "unlicense": ["The Unlicense", "license: Unlicense"],
}
#: Notices of licences of no family here.
FOREIGN = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC License", "This software is provided as-is, without any express or implied warranty.", "zlib License", "license: ISC", "license: Zlib",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License - v 2.0",
    "Distributed under the Boost Software License, Version 1.0.", "Licensed under the EUPL, Version 1.2", "European Union Public Licence v1.2", "Artistic License 2.0",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Microsoft Public License", "Common Development and Distribution License version 1.0",
    "Python Software Foundation License Version 2", "Licensed under the Academic Free License version 3.0", "GNU Free Documentation License, Version 1.3", "GNU GENERAL PUBLIC LICENSE", "GNU LICENSE",
    "Creative Commons Attribution-NoDerivatives 4.0", "Licensed under CC BY-ND 4.0.", "Creative Commons",
]
#: The sentences that the probabilities are calibrated on; the fit has none of them.
HELD = {
    "mit": ["Available under the MIT licence, see the file", "code is MIT License"], "gpl-3.0": ["this tool is released under GPLv3", "the GNU General Public License version 3 applies"],
    "gpl-2.0": ["distributed under the GNU General Public License version 2", "its licence is GPLv2"], "apache-2.0": ["the project uses the Apache License version 2.0", "Apache 2.0 license text"],
    "bsd": ["under a BSD license with three clauses", "BSD 3-Clause license applies"], "cc-by": ["photos under Creative Commons Attribution 4.0", "images: CC BY 4.0 license"],
    "cc-by-sa": ["text under CC BY-SA 4.0 license", "shared under Creative Commons Attribution-ShareAlike 4.0"], "mpl-2.0": ["files under the Mozilla Public License 2.0"], "lgpl": ["linked under the GNU Lesser General Public License"],
    "agpl-3.0": ["served under the GNU Affero General Public License"], "cc0": ["dedicated under CC0 1.0 license"],
    UNKNOWN: [
        "Boost Software License Version 1.0 of August 2003", "the Eclipse Public License v 1.0 covers the plugin", "Open Software License 3.0", "Academic license for students, version 2", "PHP License, version 3.01",
        "Her pilot license was renewed on the third", "The copyright notice was printed on page 2", "they asked permission to redistribute food", "a general public warranty", "All permissions on the software server were reset",
        "The commons attribution plaque", "version 2.0 of the software shipped without a license key", "Public hearings on the licence fee", "X11 License Distribution Modification Variant", "Sun Public License Version 1.0",
    ],
}
#: The words of which a feature must hold one: words of licences, and names of families that are no words.
ANCHORS = (
    "license", "licensed", "licenses", "licence", "copyright", "warranties", "redistribution", "redistributions", "redistribute", "permission", "software",
    "agpl", "agplv3", "bsd", "cc0", "commons", "copyleft", "gnu", "gpl", "gplv2", "gplv3", "lgpl", "lgplv2", "lgplv3", "mozilla", "mpl", "spdx", "unlicense",
)

_WORD = r"[\p{L}\p{N}]+"
_ANCHOR = r"(?i)(?<![a-z0-9])(?:" + "|".join(ANCHORS) + r")(?![a-z0-9])"


def forms() -> dict[str, list[str]]:
    """All template sentences of the families, long and short."""
    return {f: [*ss, *SHORT[f]] for f, ss in TEMPLATES.items()}


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def ngrams(w: list[str]) -> set[str]:
    """Word 1- to 3-grams."""
    out = set()
    for n in (1, 2, 3):
        out.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    return out


def features(text: str) -> set[str]:
    w = words(text)
    return ngrams(w) if set(w) & set(ANCHORS) else set()


@cache
def model() -> tuple[list[str], dict[str, np.ndarray], np.ndarray]:
    """Classes, non-zero weights by n-gram, and biases, scaled so that the probabilities fit sentences held out from the fit."""
    rows = [(s, f) for f, ss in forms().items() for s in ss for _ in range(3)] + [(s, UNKNOWN) for s in OTHERS + FOREIGN for _ in range(2)]
    rng = np.random.default_rng(5)
    filler = [x for s in OTHERS for x in words(s) if x not in ANCHORS]
    noisy = lambda s: " ".join((*rng.choice(filler, int(rng.integers(2, 12))), s, *rng.choice(filler, int(rng.integers(2, 12)))))
    rows += [(noisy(s), f) for s, f in list(rows)]
    held = [(x, f) for f, ss in HELD.items() for s in ss for x in (s, noisy(s))]
    for _ in range(120):  # single anchors among other words
        w = list(rng.choice(filler, int(rng.integers(3, 14))))
        w.insert(int(rng.integers(0, len(w))), str(rng.choice(ANCHORS)))
        rows.append((" ".join(w), UNKNOWN))
    classes = sorted(TEMPLATES) + [UNKNOWN]
    count = Counter(g for s, f in rows if f != UNKNOWN for g in features(s))
    vocab = {g: i for i, g in enumerate(sorted(g for g, n in count.items() if n >= 3))}

    def matrix(data):
        x, y = np.zeros((len(data), len(vocab) + 1)), np.zeros((len(data), len(classes)))
        for r, (s, f) in enumerate(data):
            x[r, [vocab[g] for g in features(s) if g in vocab]] = 1
            x[r, -1], y[r, classes.index(f)] = 1, 1
        return x, y

    def softmax(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    x, y = matrix(rows)
    w = np.zeros((x.shape[1], len(classes)))
    ahead, rate, t = w.copy(), 4.0 / np.linalg.norm(x, 2) ** 2 * len(rows), 1.0
    for _ in range(600):  # accelerated proximal steps
        new = ahead - rate * (x.T @ (softmax(x @ ahead) - y) / len(rows))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * 2e-4, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (old - 1) / t * (new - w), new
    hx, hy = matrix(held)
    loss = lambda a: -np.log((softmax(a * hx @ w) * hy).sum(1) + 1e-12).mean()
    scale = min(np.linspace(0.3, 3, 28), key=loss)
    w = w * scale
    return classes, {g: w[i] for g, i in vocab.items() if np.abs(w[i]).max() > 1e-9}, w[-1]


def may_hold(text) -> Column:
    """Whether a text holds a word of which every feature holds one."""
    return F.col(text).rlike(_ANCHOR)


def scan_licences(documents: DataFrame, text_col: str = "text", least: float = 0.6, overlap: float = 0.7) -> DataFrame:
    """The lines and runs of lines that hold a licence word, one row each: every input column but the text, paragraph (from 0),
    family, probability, similarity and confirmed. Family is "unknown" below `least`."""
    spark = documents.sparkSession
    classes, weights, bias = model()
    kept = [c for c in documents.columns if c != text_col]
    inputs = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(0).alias("_none"))
    # Numbers are given once: the branches below must agree on them even after an executor is lost.
    texts = settle(documents.select(inputs.alias("_in"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_t")).filter(F.col("_t").rlike(_ANCHOR)))
    lines = texts.select("_in", "_row", F.posexplode(F.split("_t", "\n")).alias("paragraph", "_p"))
    blank = F.col("_p").rlike(r"^\s*$")
    lines = lines.withColumn("_run", F.count_if(blank).over(Window.partitionBy("_row").orderBy("paragraph"))).filter(~blank)
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "_p"))), lambda x: x["_p"]), " ")
    runs = lines.groupBy("_row", "_run").agg(F.first("_in").alias("_in"), F.min("paragraph").alias("paragraph"), in_order.alias("_p"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    hit = lines.withColumn("_whole", F.lit(False)).unionByName(runs.withColumn("_whole", F.lit(True))).filter(F.col("_p").rlike(_ANCHOR))
    w: Column = F.regexp_extract_all(F.lower("_p"), F.lit(_WORD), 0)
    gram = lambda n: F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.array_join(F.slice("_w", i + 1, n), " "))
    grams = F.array_distinct(F.concat(*(F.when(F.size("_w") >= n, gram(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3))))
    hit, key = hit.withColumn("_w", w), ["_row", "paragraph", "_whole"]
    table = spark.createDataFrame([(g, [float(v) for v in x]) for g, x in sorted(weights.items())], "gram string, weight array<double>")
    scored = hit.select(*key, F.explode(grams).alias("gram")).join(F.broadcast(table), "gram")
    # Fixed-point sums do not depend on the order of rows.
    total = scored.groupBy(*key).agg(*(F.sum(F.round(F.col("weight")[i] * 1_000_000).cast("long")).alias(f"s{i}") for i in range(len(classes))))
    z = F.array(*(F.coalesce(F.col(f"s{i}"), F.lit(0)) / 1_000_000.0 + F.lit(float(bias[i])) for i in range(len(classes))))
    top = hit.join(total, key, "left").withColumn("_z", z).withColumn("_m", F.array_max("_z"))
    share = 1 / F.aggregate("_z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_m")))
    best = F.element_at(F.array(*map(F.lit, classes)), F.array_position("_z", F.col("_m")).cast("int"))
    top = top.withColumn("probability", share).withColumn("family", F.when((share >= least), best).otherwise(UNKNOWN))
    # Template comparison: the largest share of one template sentence's words that the line holds, or of its 3-grams of
    # words that the run holds, whose many words would hold those of a sentence by chance.
    top = top.withColumn("_c", F.when(F.col("_whole"), F.when(F.size("_w") >= 3, gram(3))).otherwise(F.col("_w")))
    share = lambda t: F.size(F.array_intersect("_c", F.array(*map(F.lit, t)))) / F.lit(float(len(t))) if t else F.lit(0.0)
    threes = lambda w: sorted({" ".join(w[i : i + 3]) for i in range(len(w) - 2)})
    held = F.array(*(F.coalesce(F.greatest(*(F.when(F.col("_whole"), share(threes(words(s)))).otherwise(share(sorted(set(words(s))))) for s in forms()[f])), F.lit(0.0)) for f in classes[:-1]))
    top = top.withColumn("_h", held)
    # Other sentences of a run blur its scores: where a run holds a template sentence, the comparison names the family.
    named = F.when(F.col("_whole") & (F.array_max("_h") >= overlap), F.array_position("_h", F.array_max("_h")).cast("int"))
    top = top.withColumn("_f", named).withColumn("family", F.when(F.col("_f").isNull(), F.col("family")).otherwise(F.element_at(F.array(*map(F.lit, classes)), F.col("_f"))))
    top = top.withColumn("probability", F.when(F.col("_f").isNull(), F.col("probability")).otherwise(F.col("probability") * F.exp(F.element_at("_z", F.col("_f")) - F.col("_m"))))
    top = top.withColumn("similarity", F.when(F.col("family") == UNKNOWN, 0.0).otherwise(F.element_at("_h", F.array_position(F.array(*map(F.lit, classes[:-1])), F.col("family")).cast("int"))))
    alone = F.collect_set(F.when(~F.col("_whole") & (F.col("similarity") >= overlap), F.col("family"))).over(Window.partitionBy("_row", "_run"))
    top = top.withColumn("_alone", alone).filter(~(F.col("_whole") & F.array_contains("_alone", F.col("family"))))
    return top.select("_row", *(F.col("_in")[c].alias(c) for c in kept), "paragraph", "family", "probability", "similarity", (F.col("similarity") >= overlap).alias("confirmed"))
