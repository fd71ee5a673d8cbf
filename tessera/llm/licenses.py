"""License scans: sparse TF-IDF cosine to templates, then inheritance by directory, in DataFrame operations alone.

Units are lines (headers and notices) and whole files (licence files).  The
vocabulary is that of the templates, a few hundred words; its document
frequencies come from all files.  No template word is a stop word: a notice that
a hot source repeats has common words only, and they are what tells it apart.
A unit's vector holds its vocabulary words by tf-idf; its other words weigh as
much as a word of a single file each.  Units
are compared inside their row, and only those whose vocabulary part can reach
the cosine are compared with templates: by Cauchy and Schwarz the template words
that a unit holds must carry the squared cosine of the template, so one of the
template's heaviest words is among them.  Texts are never shuffled.  A file takes
the license of its best line or of its whole text; one without takes that of the
nearest directory above it that holds a licence file, found by equi-joins on
the directories of its path.

Defined results: a null text or path has no license; ties go to the first
license by name, then to the first path; repeated rows are scanned one by one
and share their path's result; extra columns pass through unless they have a
result's name.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Notices to compare with (fixed values: the usual public wording).
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Openings and headings of licence texts and standard headers; they may be wrapped over lines.
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
PASSAGES = {
    "AGPL-3.0#header": _GNU.format("Affero General Public License", 3),
    "AGPL-3.0#text": "GNU Affero General Public License Version 3, 19 November 2007",
    "Apache-2.0#header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "Apache-2.0#text": "Apache License Version 2.0, January 2004",
    "BSD-2-Clause#text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause#text": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0#header": _GNU.format("General Public License", 2),
    "GPL-2.0#text": "GNU General Public License Version 2, June 1991",
    "GPL-3.0#header": _GNU.format("General Public License", 3),
    "GPL-3.0#text": "GNU General Public License Version 3, 29 June 2007",
    "ISC#text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0#header": _GNU.format("Lesser General Public License", 3),
    "LGPL-3.0#text": "GNU Lesser General Public License Version 3, 29 June 2007",
    "MIT#text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0#header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense#text": "This is free and unencumbered software released into the public domain.",
}
#: A passage is looked for from a line with one of these words, or the line before it, over up to WINDOW lines with words.
ANCHORS, WINDOW = ["license", "licensed", "neither", "permission", "redistribute", "redistribution", "unencumbered"], 10
SPDX = r"(?i)SPDX-License-Identifier:\s*\(?([a-z0-9.-]*[a-z0-9])"
#: Files whose license is that of their directory.
LICENCE_FILE = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying)[^/]*$"
LINE_COSINE, FILE_COSINE = 0.8, 0.5
#: Share of the files up to which a template word counts: all of them.
MAX_DF = 1.0
SPLIT = r"[^\p{L}\p{N}.-]+|\.(?=$|[^\p{N}])"


def terms(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w.-]+|\.(?=$|\D)", text.lower()) if w]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def _models(files: DataFrame, *sets: dict[str, str]):
    """For each set of templates: weights of the vocabulary, weight of other words, and unit template vectors."""
    vocabulary = sorted({w for templates in sets for t in templates.values() for w in terms(t)})
    total = files.count()
    listed = F.array(*[F.lit(w) for w in vocabulary])  # the templates' words
    found = files.select(F.explode(F.array_intersect(words(F.col("_text")), listed)).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    df = {r["w"]: r["n"] for r in found}
    models = []
    for templates in sets:
        idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for t in templates.values() for w in terms(t)}
        vectors = {}
        for name, t in templates.items():
            tf: dict[str, int] = {}
            for w in terms(t):
                tf[w] = tf.get(w, 0) + 1
            size = math.sqrt(sum((n * idf[w]) ** 2 for w, n in tf.items()))
            if size:
                vectors[name] = {w: n * idf[w] / size for w, n in tf.items()}
        models.append((idf, math.log((1 + total) / 2) + 1, vectors))
    return models


def _heavy(vectors, least: float) -> list[str]:
    """Words of which a unit must hold one to come to that cosine with a template: the others carry too little of it."""
    out = set()
    for vector in vectors.values():
        left = 1.0
        for w, x in sorted(vector.items(), key=lambda v: (-v[1], v[0])):
            if left < least * least - 1e-6:
                break
            out.add(w)
            left -= x * x
    return sorted(out)


def _held(distinct: Column, vectors, least: float) -> Column:
    """Whether the words of a unit carry enough of a template to come to that cosine."""
    share = [sum((F.when(F.array_contains(distinct, w), x * x).otherwise(0.0) for w, x in v.items()), F.lit(0.0)) for v in vectors.values()]
    return F.greatest(F.lit(0.0), *share) >= least * least - 1e-6


def _best(known: Column, n: Column, model, least: float) -> Column:
    """Best (minus cosine, license) of a unit with those vocabulary words among n words, or null."""
    idf, other, vectors = model
    weight = F.from_json(F.lit(json.dumps(idf)), "map<string,double>")
    times = lambda w: F.size(known) - F.size(F.array_remove(known, w))
    part = F.aggregate(F.array_distinct(known), F.lit(0.0), lambda a, w: a + F.pow(times(w) * F.element_at(weight, w), F.lit(2.0)))
    size2 = part + (n - F.size(known)) * (other * other)
    scores = []
    for name, vector in vectors.items():
        dot = sum((times(F.lit(w)) * (idf[w] * x) for w, x in vector.items()), F.lit(0.0))
        # rounded, so that the order of sums decides nothing
        scores.append(F.struct((-F.round(dot / F.sqrt(size2), 9)).alias("c"), F.lit(name).alias("license")))
    reach = (F.size(known) > 0) & (part >= least * least * size2)
    return F.when(reach, F.array_min(F.filter(F.array(*scores), lambda s: s["c"] <= -least)))


def _passages(scanned: DataFrame, model, least: float) -> DataFrame:
    """(_key, passage) of the files with a passage in adjacent lines, or an SPDX tag."""
    idf, _, vectors = model
    anchors = F.array(*[F.lit(w) for w in ANCHORS])
    some = scanned.where(F.col("_text").rlike("(?i)" + "|".join(ANCHORS)))
    ws = some.select("_key", F.filter(F.transform(F.split("_text", "\n"), words), lambda w: F.size(w) > 0).alias("ws")).where(F.size("ws") > 0)
    hit = lambda w: F.coalesce(F.arrays_overlap(w, anchors), F.lit(False))
    starts = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: hit(F.get("ws", i)) | hit(F.get("ws", i + 1)))
    near = ws.select("_key", F.explode(F.transform(starts, lambda i: F.slice("ws", i + 1, WINDOW))).alias("near"))
    window = near.select("_key", F.explode(F.transform(F.sequence(F.lit(1), F.size("near")), lambda k: F.flatten(F.slice("near", F.lit(1), k)))).alias("w"))
    window = window.select("_key", F.filter("w", lambda x: x.isin(sorted(idf))).alias("known"), F.size("w").alias("n")).where(_held(F.col("known"), vectors, least))
    best = window.select("_key", _best(F.col("known"), F.col("n"), model, least).alias("p")).where("p is not null")
    best = best.select("_key", "p.c", F.substring_index("p.license", "#", 1).alias("license"))
    ids = {n.split("#")[0] for n in [*TEMPLATES, *PASSAGES]}
    known = F.create_map(*[F.lit(x) for n in sorted(ids) for x in (n.lower(), n)])
    tag = F.regexp_replace(F.lower(F.regexp_extract("_text", SPDX, 1)), "-(?:only|or-later)$", "")
    tags = some.select("_key", F.lit(-2.0).alias("c"), F.get(F.array(known[tag]), F.lit(0)).alias("license")).where("license is not null")
    got = best.unionAll(tags).groupBy("_key").agg(F.min(F.struct("c", "license")).alias("p"), F.max(F.col("license") == "BSD-3-Clause").alias("third"))
    # the two BSD texts open alike; the third clause tells them apart
    name = F.when((F.col("p.license") == "BSD-2-Clause") & F.col("third"), "BSD-3-Clause").otherwise(F.col("p.license"))
    return got.select("_key", F.struct(F.greatest("p.c", F.lit(-1.0)).alias("c"), name.alias("license")).alias("passage"))


def directories(path: Column) -> Column:
    """Directories above a path, with their depth: a/b/c gives a/b (2), a (1) and the root '' (0)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, str] = TEMPLATES, line_cosine: float = LINE_COSINE, file_cosine: float = FILE_COSINE) -> DataFrame:
    """files with license, cosine, license_from (line, passage, file or directory) and license_path."""
    rows = files.drop("license", "cosine", "license_from", "license_path").withColumns({"_path": F.col(path), "_text": F.col(text), "_key": F.xxhash64(F.col(path), F.col(text))})
    scanned = rows.select("_path", "_text", "_key").where("_path is not null and _text is not null")
    model, long = _models(scanned, templates, PASSAGES)
    kind = "struct<c:double,license:string>"
    idf, _, vectors = model
    if vectors:
        units = scanned.select("_key", F.transform(F.split("_text", "\n"), words).alias("ws"))
        units = units.select("_key", F.transform("ws", lambda w: F.filter(w, lambda x: x.isin(sorted(idf)))).alias("known"), F.transform("ws", F.size).alias("n"))
        units = units.where(F.size(F.flatten("known")) > 0)
        heavy = F.array(*[F.lit(w) for w in _heavy(vectors, line_cosine)])
        near = F.filter(F.arrays_zip("known", "n"), lambda u: F.arrays_overlap(u["known"], heavy))
        by_line = F.array_min(F.transform(F.filter(near, lambda u: _held(u["known"], vectors, line_cosine)), lambda u: _best(u["known"], u["n"], model, line_cosine)))
        by_file = units.select("_key", by_line.alias("line"), F.flatten("known").alias("known"), F.aggregate("n", F.lit(0), lambda a, x: a + x).alias("n"))
        by_file = by_file.withColumn("held", _held(F.array_distinct("known"), vectors, file_cosine))
        found = by_file.select("_key", "line", F.when(F.col("held"), _best(F.col("known"), F.col("n"), model, file_cosine)).alias("file")).where("line is not null or file is not null")
    else:
        found = scanned.select("_key", F.lit(None).cast(kind).alias("line"), F.lit(None).cast(kind).alias("file")).limit(0)
    none = F.lit(None).cast(kind)
    found = found.select("_key", "line", "file", none.alias("passage")).unionAll(_passages(scanned, long, line_cosine).select("_key", none.alias("line"), none.alias("file"), F.col("passage").cast(kind)))
    found = found.groupBy("_key").agg(*[F.min(c).alias(c) for c in ("line", "passage", "file")])
    # a passage counts as a line that is wrapped
    found = found.withColumn("wrapped", F.col("line").isNull() & F.col("passage").isNotNull()).withColumn("line", F.coalesce("line", "passage"))
    own = found.select("_key", "wrapped", F.col("passage.license").alias("passage_license"), (-F.col("passage.c")).alias("passage_cosine"), F.col("line.license").alias("line_license"), (-F.col("line.c")).alias("line_cosine"), F.col("file.license").alias("file_license"), (-F.col("file.c")).alias("file_cosine")).distinct()
    own = cut(own, "licenses")
    light = cut(scanned.select("_key", "_path").distinct().join(own, "_key", "left"), "license-paths")
    whole = F.col("passage_license").isNotNull() & F.col("_path").rlike(LICENCE_FILE)
    light = light.withColumns({"file_license": F.when(whole, F.col("passage_license")).otherwise(F.col("file_license")), "file_cosine": F.when(whole, F.col("passage_cosine")).otherwise(F.col("file_cosine"))})
    holder = light.where("file_license is not null").select(F.regexp_replace("_path", "/?[^/]*$", "").alias("dir"), "file_license", "file_cosine", "_path")
    holder = holder.groupBy("dir").agg(F.min(F.struct((-F.col("file_cosine")).alias("c"), F.col("file_license").alias("l"), F.col("_path").alias("p"))).alias("m")).select("dir", F.col("m.l").alias("dir_license"), (-F.col("m.c")).alias("dir_cosine"), F.col("m.p").alias("dir_path"))
    bare = light.where("line_license is null and file_license is null").select("_path").distinct()
    above = bare.select("_path", F.explode(directories(F.col("_path"))).alias("d")).select("_path", "d.depth", "d.dir").join(holder, "dir")
    near = above.groupBy("_path").agg(F.max(F.struct("depth", "dir_license", "dir_cosine", "dir_path")).alias("m")).select(F.col("_path"), "m.dir_license", "m.dir_cosine", "m.dir_path")
    out = rows.drop("_text").join(own, "_key", "left").join(near, "_path", "left")
    bare = F.col("line_license").isNull() & F.col("file_license").isNull()
    line_wins = F.col("line_license").isNotNull()
    out = out.withColumns({
        "license": F.coalesce("line_license", "file_license", "dir_license"),
        "cosine": F.when(line_wins, F.col("line_cosine")).otherwise(F.coalesce("file_cosine", F.when(bare, F.col("dir_cosine")))),
        "license_from": F.when(F.col("wrapped"), "passage").when(line_wins, "line").when(F.col("file_license").isNotNull(), "file").when(F.col("dir_license").isNotNull(), "directory"),
        "license_path": F.when(~bare, F.col("_path")).otherwise(F.col("dir_path")),
    })
    return out.drop("_path", "_key", "wrapped", "passage_license", "passage_cosine", "line_license", "line_cosine", "file_license", "file_cosine", "dir_license", "dir_cosine", "dir_path")
