"""Licence scans: a trained paragraph classifier, evaluated with built-in functions.

A paragraph is a line, or up to `WRAP` lines that follow each other (a blank line ends
a paragraph), as notices are wrapped.  Its features are words and runs of two and three words,
lower-cased, that the training templates contain (common words alone are none).
A multinomial logistic regression, trained on the driver on the fixed templates
and negative lines below, gives each licence family and `unknown` a probability;
its temperature is fitted on lines kept out of the training: other wordings around
the templates, words dropped from them, and other negative lines.  A prediction
counts if its probability reaches `CERTAIN` and a template of that family confirms
it: the template's weighted features that the paragraph has, over all of the
template's, must reach `CONFIRM`.

The main path is a projection of each document's lines, a filter for lines with
a feature word (a line without any has the score of an empty one: unknown), runs of
words that are features, and two joins with tables of fixed size (weights and
templates).  No Python runs on executors.

Edge cases: null or empty text has no paragraphs with a licence; repeated
licence lines count each; a line of any length is a paragraph, and all of a very long
text's lines are scored; repeated rows, and rows with equal or null doc_ids, are
rows as any other; columns but doc_id and text are not read; an empty table gives no
rows; several families in a document are listed in order of their name.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
CERTAIN = 0.7
CONFIRM = 0.5
WRAP = 6
WORDS = r"[a-z0-9]+(?:[.\-+][a-z0-9]+)*"

#: Common wordings of licence notices.
TEMPLATES = {
    "agpl-3.0": ["licensed under the gnu affero general public license version 3", "gnu affero general public license v3", "agpl-3.0",
                 "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "apache-2.0": ["licensed under the apache license version 2.0", "apache license version 2.0", "spdx-license-identifier apache-2.0",
                   "you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0"],
    "bsd-2-clause": ["licensed under the bsd 2-clause license", "simplified bsd license", "spdx-license-identifier bsd-2-clause"],
    "bsd-3-clause": ["licensed under the bsd 3-clause license", "new bsd license", "redistribution and use in source and binary forms with or without modification are permitted", "spdx-license-identifier bsd-3-clause"],
    "cc-by-4.0": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by-nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by-sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc0-1.0": ["dedicated to the public domain under cc0 1.0", "creative commons zero public domain dedication"],
    "gpl-2.0": ["licensed under the gnu general public license version 2", "gnu general public license v2", "spdx-license-identifier gpl-2.0",
                "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-3.0": ["licensed under the gnu general public license version 3", "gnu general public license v3", "spdx-license-identifier gpl-3.0",
                "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "isc": ["licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl-3.0": ["licensed under the gnu lesser general public license version 3", "gnu lesser general public license v3", "spdx-license-identifier lgpl-3.0",
                 "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "spdx-license-identifier mit"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license version 2.0", "spdx-license-identifier mpl-2.0"],
    "proprietary": ["all rights reserved", "proprietary and confidential unauthorized copying is prohibited", "no part of this work may be reproduced without permission"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense"],
}
#: Lines that use such words without a licence.
NEGATIVE = [
    "he lost his driving license last year", "the license plate was stolen", "a licensed doctor must sign the form", "the software was released in march", "version 2.0 of the plan was better than version 3",
    "the general public was not admitted", "this work is hard", "free of charge parking for visitors", "copyright law is complicated", "a copy of the letter was sent",
    "any person may enter the public library", "the apache helicopter landed", "students at mit built a robot", "the mozilla foundation published a report", "international trade under the terms of the contract",
    "permission was granted by the council", "the licensing fee rose by 4.0 percent", "attribution of the painting is uncertain", "the creative commons of the village", "source and binary stars were observed",
    "the foundation published the second version of its program", "you can use the free hall under the terms of the council", "either version of the story is possible", "the library is open to the general public at no charge",
    "any later version of the plan needs a vote", "you may obtain a copy of the minutes at the office", "redistribution of land was the aim of the law", "the public domain of the king was sold", "warranty claims must be made in writing",
    "the author of the notice is unknown", "he was granted a licence to sell wine", "modify the recipe as you like", "all rights of way are reserved for farmers", "a file may not be removed from the archive",
]
#: Words that are no feature alone.
COMMON = "a all and any by for forms from in is it its may no not of on or that the this to under use was with without work be are as an at his he she copy person".split()
_PLAIN = ["this {0}", "the project is {0}", "this file is {0}", "this work is {0}", "{0} see the file license", "code in this folder is {0}", "{0}"]
_OTHER = ["our sources are {0} unless noted", "{0} all others see below", "notice {0}"]


def _grams(words: list[str]) -> set[str]:
    out = {w for w in words if w not in COMMON}
    for n in (2, 3):
        out |= {" ".join(words[i : i + n]) for i in range(len(words) - n + 1) if any(w not in COMMON for w in words[i : i + n])}
    return out


def _words(line: str) -> list[str]:
    return re.findall(WORDS, line.lower())


class LicenceModel:
    """Weights of features, and calibrated temperature; trained on the templates alone."""

    def __init__(self, rounds: int = 250, rate: float = 0.5, l2: float = 2e-4):
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        own = sorted(set().union(*(_grams(_words(t)) for ts in TEMPLATES.values() for t in ts)))
        self.grams = {g: i for i, g in enumerate(own)}
        held = NEGATIVE[::4]
        lines = [(p.format(t), f) for f, ts in TEMPLATES.items() for t in ts for p in _PLAIN]
        unknown = [x for x in NEGATIVE if x not in held] + [""] * 20 + [" ".join(w) for w in itertools.permutations(["public", "license", "version", "released", "software"], 2)]
        lines += [(n, UNKNOWN) for n in unknown for _ in range(2)]
        check = [(p.format(" ".join(w for i, w in enumerate(_words(t)) if i % 7 != k or len(_words(t)) < 5)), f) for f, ts in TEMPLATES.items() for t in ts for k, p in enumerate(_OTHER)]
        check += [(x, UNKNOWN) for x in held for _ in range(4)]
        x, y = self._matrix(lines)
        self.weights, self.bias = np.zeros((len(own), len(self.families))), np.zeros(len(self.families))
        for _ in range(rounds):
            p = self._softmax(x @ self.weights + self.bias) - y
            self.weights -= rate * (x.T @ p / np.sqrt(len(x)) / 4 + l2 * self.weights)
            self.bias -= rate * p.mean(0)
        cx, cy = self._matrix(check)
        z = cx @ self.weights + self.bias
        losses = [(-(np.log(self._softmax(z / t) + 1e-12) * cy).sum(), t) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)]
        self.temperature = min(losses)[1]
        self.weights, self.bias = np.round(self.weights / self.temperature, 6), np.round(self.bias / self.temperature, 6)
        rare = {g: 1 / sum(g in _grams(_words(t)) for ts in TEMPLATES.values() for t in ts) for g in own}
        self.templates = [(f, i, {g: rare[g] for g in _grams(_words(t))}) for f, ts in sorted(TEMPLATES.items()) for i, t in enumerate(ts)]
        self.vocabulary = sorted({w for g in own for w in g.split(" ") if w not in COMMON})

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _matrix(self, lines):
        x, y = np.zeros((len(lines), len(self.grams))), np.zeros((len(lines), len(self.families)))
        for r, (line, family) in enumerate(lines):
            for g in _grams(_words(line)):
                if g in self.grams:
                    x[r, self.grams[g]] = 1
            y[r, self.families.index(family)] = 1
        return x, y

    def predict(self, line: str) -> tuple[str, float, float, bool]:
        """Family, its probability, template coverage, confirmed: what the query computes, for one line in Python."""
        grams = _grams(_words(line))
        z = self.bias + sum((self.weights[self.grams[g]] for g in grams if g in self.grams), np.zeros(len(self.families)))
        p = self._softmax(z[None])[0]
        best = int(p.argmax())
        cover = max((sum(w for g, w in t.items() if g in grams) / sum(t.values()) for f, _, t in self.templates if f == self.families[best]), default=0.0)
        return self.families[best], float(p[best]), cover, self.families[best] != UNKNOWN and p[best] >= CERTAIN and cover >= CONFIRM


def _runs(words: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _scored(docs: DataFrame, model: LicenceModel | None) -> DataFrame:
    """Each document's lines with a feature word, scored; of a document without any, one row with a null line."""
    model = model or LicenceModel()
    spark = docs.sparkSession
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.regexp_extract_all(F.lower(x), F.lit(WORDS), F.lit(0)).alias("words")))
    found = F.filter(lines, lambda x: F.exists(x["words"], lambda w: w.isin(model.vocabulary)))
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", found.alias("found"))

    def paragraph(x: Column, i: Column, n: int) -> Column:
        """The n lines from the i-th found one, as far as they follow each other; run numbers lines that do."""
        near = F.filter(F.slice("found", i + 1, n), lambda y, j: y["line"] == x["line"] + j)
        return F.struct(x["line"].alias("line"), (x["line"] - i).alias("run"), F.size(near).alias("lines"), F.flatten(F.transform(near, lambda y: y["words"])).alias("words"))

    units = F.concat(F.transform("found", lambda x, i: paragraph(x, i, 1)), F.filter(F.transform("found", lambda x, i: paragraph(x, i, WRAP)), lambda u: u["lines"] > 1))
    lines = numbered.select("row", "doc_id", F.explode_outer(units).alias("at")).select("row", "doc_id", "at.line", "at.run", "at.lines", "at.words")
    known = F.filter(F.array_distinct(F.concat("words", _runs(F.col("words"), 2), _runs(F.col("words"), 3))), lambda g: g.isin(list(model.grams)))
    grams = lines.select("row", "doc_id", "line", "run", "lines", F.explode_outer(known).alias("gram"))
    weights = spark.createDataFrame([(g, [float(v) for v in model.weights[i]]) for g, i in model.grams.items()], "gram string, weight array<double>")
    hits = grams.join(F.broadcast(weights), "gram", "left")
    per = hits.groupBy("row", "doc_id", "line", "run", "lines").agg(*(F.coalesce(F.sum(F.element_at("weight", i + 1)), F.lit(0.0)).alias(f"z{i}") for i in range(len(model.families))), F.collect_set("gram").alias("found"))
    z = F.array(*(F.col(f"z{i}") + float(b) for i, b in enumerate(model.bias)))
    per = per.select("row", "doc_id", "line", "run", "lines", "found", z.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    family = F.element_at(F.array(*map(F.lit, model.families)), F.array_position("z", F.col("top")).cast("int"))
    per = per.select("row", "doc_id", "line", "run", "lines", "found", family.alias("family"), (1 / total).alias("probability"))
    templates = spark.createDataFrame([(f, list(t), {g: float(w) for g, w in t.items()}, float(sum(t.values()))) for f, _, t in model.templates], "family string, grams array<string>, worth map<string,double>, whole double")
    both = per.join(F.broadcast(templates), "family", "left")
    shared = F.aggregate(F.array_intersect("grams", "found"), F.lit(0.0), lambda s, g: s + F.col("worth")[g])
    best = both.groupBy("row", "doc_id", "line", "run", "lines", "family", "probability").agg(F.coalesce(F.max(shared / F.col("whole")), F.lit(0.0)).alias("coverage"))
    sure = (F.col("family") != UNKNOWN) & (F.col("probability") >= CERTAIN) & (F.col("coverage") >= CONFIRM)
    return best.withColumn("confirmed", sure & F.col("line").isNotNull())


def paragraphs(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row for each paragraph with a feature word: doc_id, line (its first, from 0), lines (how many), family, probability, coverage, confirmed."""
    return _scored(docs, model).where("line is not null").drop("row", "run")


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """Per document: doc_id, n_lines with a licence, families (sorted), the best probability; 0, [] and null without one.

    A run of lines that only together is a licence counts once.
    """
    sure = F.col("confirmed")
    own = F.collect_set(F.when(sure & (F.col("lines") == 1), F.col("family")))
    wide = F.collect_set(F.when(sure & (F.col("lines") > 1), F.col("family")))
    per = _scored(docs, model).groupBy("row", "doc_id", "run").agg(F.count_if(sure & (F.col("lines") == 1)).alias("n"), own.alias("own"), wide.alias("wide"), F.max(F.when(sure, F.col("probability"))).alias("probability"))
    n = F.when(F.col("n") > 0, F.col("n")).otherwise((F.size("wide") > 0).cast("long"))
    per = per.groupBy("row", "doc_id").agg(F.sum(n).alias("n_lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("own", "wide"))))).alias("families"), F.max("probability").alias("probability"))
    return per.drop("row")
