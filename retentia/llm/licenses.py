"""License scans: TF-IDF cosine to templates, and inheritance along folders.

Terms are runs of letters and digits in lower case.  A term weighs its count
times ln((1 + T) / (1 + d)) + 1, where d of the T templates have it.  Units of
a file are its runs of one to three consecutive lines, and for a licence file
its whole text.  The best unit decides.

A unit's cosine to a template is at most the share of the template's length
that its shared terms have.  So a few cue terms of each template suffice: what
lacks all of them can't reach the threshold and isn't compared.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.llm.base import ascii_lower, let, renamed, returned
from retentia.session import materialise

THRESHOLD = 0.7
LINES = 3
LICENSE_FILE = r"(?i)(^|/)(un)?licen[cs]e[^/]*$|(^|/)copying[^/]*$"

# Wording by which licences are named.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]

# Words that don't count, in templates and units alike.
STOP = (
    "a and any are as at be by for from free in into is it may not of on only or that the this to under use was with "
    "without work you"
).split()
_TERM = "[a-z0-9]+"


def _terms(text: str) -> Counter[str]:
    return Counter(t for t in re.findall(_TERM, text.lower()) if t not in STOP)


class Templates:
    """Weights of the templates' terms and the cues that follow from them."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> None:
        counts = [_terms(text) for _, text in templates]
        having = Counter(t for c in counts for t in c)
        self.threshold = threshold
        self.default = math.log(1 + len(counts)) + 1
        self.idf = {t: math.log((1 + len(counts)) / (1 + d)) + 1 for t, d in having.items()}
        cues: set[str] = set()
        self.parts: list[list[dict]] = []
        for (name, _), count in zip(templates, counts, strict=True):
            weights = {t: n * self.idf[t] for t, n in count.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            parts = [{"template": len(self.parts), "license": name, "term": t, "weight": w / norm} for t, w in weights.items()]
            self.parts.append(parts)
            rest = norm * norm
            # Long terms first: they are rare in any prose.
            for term in sorted(weights, key=lambda t: (-len(t), t)):
                if math.sqrt(max(0.0, rest)) < threshold * norm * 0.999:
                    break
                rest -= weights[term] ** 2
                cues.add(term)
        self.cues = sorted(cues)

    def table(self, spark: SparkSession) -> DataFrame:
        """``term``, ``idf`` and its ``parts``: template, licence and weight.  A row per term of the templates."""
        parts = sorted((p for each in self.parts for p in each), key=lambda p: (p["term"], p["template"]))
        grouped = {t: list(group) for t, group in groupby(parts, key=lambda p: p["term"])}
        rows = [{"term": t, "idf": self.idf[t], "parts": group} for t, group in grouped.items()]
        kind = "array<struct<term:string,idf:double,parts:array<struct<template:int,license:string,weight:double>>>>"
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))

    def has_cue(self, text: Column) -> Column:
        """Whether a lower-case text has a cue as a term, for whole texts."""
        return F.arrays_overlap(F.split(text, "[^a-z0-9]+"), F.array(*[F.lit(c) for c in self.cues]))

    def cue(self, text: Column) -> Column:
        """The same for short pieces of text."""
        return text.rlike(f"(?<![a-z0-9])(?:{'|'.join(self.cues)})(?![a-z0-9])")


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: Templates | None = None) -> DataFrame:
    """``path``, ``license``, ``score`` of the files in which a template is found.

    One row per path: the best unit, ties by licence name; cosines are rounded
    to six places.  A null path or text has none.  Whole texts are searched.
    """
    templates = templates or Templates()
    rows = files.select(F.col(path).alias("path"), ascii_lower(F.col(text)).alias("_text")).dropna()
    rows = rows.where(templates.has_cue(F.col("_text")))

    def units(lines: Column) -> Column:
        # A run that would go beyond the last line equals a shorter one.
        def run(k: int) -> Callable[[Column], Column]:
            return lambda i: F.concat_ws(" ", *[F.get(lines, i + j) for j in range(k)])

        places = F.sequence(F.lit(0), F.size(lines) - 1)
        runs = F.concat(*[F.transform(places, run(k)) for k in range(1, LINES + 1)])
        return F.filter(runs, templates.cue)

    whole = F.when(F.col("path").rlike(LICENSE_FILE), F.array("_text")).otherwise(F.array().cast("array<string>"))
    cut = rows.select("path", F.explode(F.array_distinct(F.concat(let(F.split("_text", "\n"), units), whole))).alias("unit"))
    cut = cut.select("path", F.xxhash64("unit").alias("unit"), F.explode(F.regexp_extract_all("unit", F.lit(_TERM), F.lit(0))).alias("term"))
    counts = cut.where(~F.col("term").isin(STOP)).groupBy("path", "unit", "term").agg(F.count(F.lit(1)).alias("n"))
    known = F.broadcast(templates.table(files.sparkSession))  # a row per term of the templates
    weighed = counts.join(known, "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(templates.default)))
    weighed = materialise(weighed.select("path", "unit", "w", "parts"), "units")
    norms = weighed.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.select("path", "unit", "w", F.inline("parts")).groupBy("path", "unit", "template", "license").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot")
    )
    scored = dots.join(norms, ["path", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    best = scored.where(F.col("score") >= templates.threshold).groupBy("path").agg(
        F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("worse"), "license"))["license"].alias("license")
    )
    return best.select("path", "license", "score")


def folder(path: Column) -> Column:
    """Everything before the last slash; empty at the top."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def inherit(files: DataFrame, found: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``own_license``, ``own_score``, ``license`` and ``origin``.

    A file without a licence of its own gets that of the nearest folder above
    it that has a licence file; ``origin`` is that folder, or the file's path.
    Of several licence files in a folder the best score counts, ties by name.
    Folders are joined once each, however many files they hold; a path's
    folders are as many as its slashes.  A null path gets nothing.  Other
    columns stay, but for those of the new names.
    """
    files, names = renamed(files)
    path = names[path]
    found = materialise(found, "found")
    held = found.where(F.col("path").rlike(LICENSE_FILE)).withColumn("dir", folder(F.col("path")))
    best = Window.partitionBy("dir").orderBy(F.col("score").desc(), "license")
    named = held.withColumn("nth", F.row_number().over(best)).where("nth = 1").select(F.col("dir").alias("above"), F.col("license").alias("given"))
    folders = files.select(folder(F.col(path)).alias("dir")).where("dir IS NOT NULL").distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    # The top folder's name is empty, as is that of the first part of an absolute path.
    chain = folders.select("dir", F.posexplode(F.array_distinct(F.concat(F.array(F.lit("")), up))).alias("depth", "above"))
    met = chain.join(named, "above")
    nearest = met.groupBy("dir").agg(F.max("depth").alias("depth"), F.max_by(F.struct("given", "above"), "depth").alias("n"))
    nearest = materialise(nearest.select("dir", F.col("n.given").alias("given"), F.col("n.above").alias("from")), "nearest")
    own = found.select(F.col("path").alias("_path"), F.col("license").alias("own_license"), F.col("score").alias("own_score"))
    rows = files.withColumn("_dir", folder(F.col(path)))
    rows = rows.join(own, F.col(path) == F.col("_path"), "left").join(
        nearest.withColumnRenamed("dir", "_above"), F.col("_dir") == F.col("_above"), "left"
    )
    made = rows.select(
        *files.columns, "own_license", "own_score", F.coalesce("own_license", "given").alias("license"),
        F.when(F.col("own_license").isNotNull(), F.col(path)).otherwise(F.col("from")).alias("origin"),
    )
    return made.select(*returned(names, made=["own_license", "own_score", "license", "origin"]))
