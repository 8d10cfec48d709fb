"""Licences by sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, saved

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
_APACHE = '(the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_OTHER_GNU, _OTHER_CC = "lesser library affero lgpl agpl", "nc nd sa noncommercial sharealike noderivatives noderivs"
_GNU_NAMES = (("GPL-2.0", "General Public License", "2", "general", _OTHER_GNU), ("GPL-3.0", "General Public License", "3", "general", _OTHER_GNU), ("LGPL-2.1", "Lesser General Public License", "2.1", "lesser", "affero"), ("LGPL-3.0", "Lesser General Public License", "3", "lesser", "affero"), ("AGPL-3.0", "Affero General Public License", "3", "affero", "lesser"))
_CC_NAMES = (
    ("CC-BY-4.0", "BY", "Attribution", "by", "attribution", _OTHER_CC), ("CC-BY-SA-4.0", "BY-SA", "Attribution-ShareAlike", "by sa", "attribution sharealike", "nc nd noncommercial noderivatives noderivs"),
    ("CC-BY-NC-4.0", "BY-NC", "Attribution-NonCommercial", "by nc", "attribution noncommercial", "nd sa sharealike noderivatives noderivs"), ("CC-BY-ND-4.0", "BY-ND", "Attribution-NoDerivatives", "by nd", "attribution noderivatives", "nc sa noncommercial sharealike"),
)
SPDX = ("Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0")
#: Licences, the words by which headers, files and tags announce them, terms that a stretch must have (a
#: family's and a version's), and terms that it and the LOOK terms behind it must not have (those of its relatives).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2", ""), ("Apache-2.0", f"Licensed under the Apache License, Version 2.0 {_APACHE}", "apache 2", ""), ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1", "apache 1", "2 0"),
    ("MIT", "Released under the MIT License", "mit", ""), ("MIT", _MIT, "permission granted charge person", ""), ("ISC", _ISC, "permission granted fee", "charge"), ("MPL-2.0", _MPL, "mozilla 2", ""),
    *((n, f"This work is licensed under the GNU {name}, version {v}", f"{own} {v.replace('.', ' ')}", bars) for n, name, v, own, bars in _GNU_NAMES),
    *((n, _GNU.format(name, v), f"{own} {v.replace('.', ' ')}", bars) for n, name, v, own, bars in _GNU_NAMES),
    *((n, f"Licensed under CC {short} 4.0", f"cc {own} 4", bars) for n, short, _, own, _, bars in _CC_NAMES),
    *((n, f"This work is licensed under the Creative Commons {name} 4.0 International License", f"commons {own} 4", bars) for n, _, name, _, own, bars in _CC_NAMES),
    ("BSD-2-Clause", _BSD, "redistribution permitted reproduce", "neither endorse"), ("BSD-3-Clause", _BSD + _BSD3, "redistribution permitted reproduce neither", ""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived rights", ""),
    *((x, f"SPDX-License-Identifier: {x}", f"spdx {x.lower().replace('-', ' ').replace('.', ' ')}", _OTHER_CC if x == "CC-BY-4.0" else "") for x in SPDX),
)
#: Terms of which one before a stretch's anchor denies it, from two before the stretch on, and terms behind a stretch in which relatives show.
DENIALS, LOOK = ("not", "never", "cannot", "isn", "aren", "wasn", "nor"), 40
#: A licence must be ahead of the next by so much where both are announced at one place.
MARGIN = 0.03
LEAST_COSINE = 0.6
MOST_TEMPLATES = 10_000
#: Words that announce a licence: the first of them in a template is its anchor.
HINT = r"^(licen[cs]ed?|copyright|permission|redistribution|spdx)$"
#: Texts without any of this are not looked into.
_QUICK = r"(?i)licen[cs]e|copyright|permission|redistribution|spdx"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)(\.[a-z0-9]+)?$"


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _weights(templates: DataFrame) -> tuple[DataFrame, Column]:
    """(template, licence, term, w) with unit length, and the weight of a term that no template has."""
    many = templates.count()
    tf = templates.select("template", "licence", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg(F.log(1 + F.lit(many) / F.count("*")).alias("idf"))
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "template").select("template", "licence", "term", "idf", (F.col("w") / F.col("norm")).alias("w")), F.log(F.lit(1.0 + many))


def _anchors(templates: DataFrame) -> list[tuple[str, int, int]]:
    """(word, place, terms) of the templates: the anchor, how many terms stand before it, and how many there are."""
    rows = templates.select(_terms(F.col("text")).alias("t")).limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    found = set()
    for r in rows:
        place = next((i for i, w in enumerate(r["t"]) if re.search(HINT, w)), None)
        if place is not None:
            found.add((r["t"][place], place, len(r["t"])))
    return sorted(found)


def _marks(templates: DataFrame) -> Column:
    """The templates' marks as one array: template, needs, bars."""
    split = lambda c: F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    rows = templates.select("template", split(F.col("needs")).alias("needs"), split(F.col("bars")).alias("bars")).collect()
    many = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    return F.array(*[F.struct(F.lit(r["template"]).alias("template"), many(r["needs"]).alias("needs"), many(r["bars"]).alias("bars")) for r in rows])


def scanned(files: DataFrame, templates: DataFrame | None = None, least: float = LEAST_COSINE, margin: float = MARGIN) -> DataFrame:
    """Per file: row (its columns but for the text), path, own (licence that its text announces), cosine, licence,
    from_path, how.

    files: path, text; templates: licence, text and, where wanted, needs and bars (at most MOST_TEMPLATES). Wherever a
    template's anchor stands in the whole text, the stretch that the template would fill there is a vector, across line
    ends and comment marks, and so is a licence file as a whole. A template counts where the stretch has all terms that
    it needs and, with LOOK terms behind it, none that it bars: so another version or a relative is no match, however
    like. A stretch with a denial before its anchor, or up to two terms before itself, counts nowhere. Where another licence comes within `margin` at one place, that place
    tells nothing. A file's own licence is that of the best cosine from `least` on, ties by name; one whose places all
    tell nothing is unknown (how), and inherits none. A file without any takes that of the licence file in the nearest
    directory at or above its own (how: inherited); else none. A file without a path is in no directory; null texts are empty. Rows stay one row each, and a row's licence
    depends on its own path and text only, whatever other rows of that path hold.
    """
    spark = files.sparkSession
    if templates is None:
        templates = spark.createDataFrame(list(TEMPLATES), "licence string, text string, needs string, bars string")
    extra = [(F.col(c) if c in templates.columns else F.lit("")).alias(c) for c in ("needs", "bars")]
    templates = saved(templates.select(F.xxhash64("licence", "text").alias("template"), "licence", "text", *extra).dropDuplicates(["template"]), "templates")
    anchors = _anchors(templates)
    w, unseen = _weights(templates)
    w = saved(w, "weights")
    text, name = F.coalesce("text", F.lit("")), F.coalesce("path", F.lit("\x01"))
    files = files.select(F.struct(*[F.col(f"`{c}`") for c in files.columns if c != "text"]).alias("row"), "path", text.alias("text"), F.unhex(F.md5(F.concat(name, F.lit("\x00"), text))).alias("key"))
    asks = F.col("text").rlike(_QUICK) | F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))

    at = F.array(*[F.struct(F.lit(word).alias("word"), F.lit(place).alias("place"), F.lit(n).alias("n")) for word, place, n in anchors] or [F.struct(F.lit("").alias("word"), F.lit(0).alias("place"), F.lit(0).alias("n"))])
    words = F.array(*[F.lit(x) for x in sorted({word for word, _, _ in anchors})] or [F.lit("")])
    units = files.where(asks).select("key", "path", _terms(F.col("text")).alias("t"))
    units = units.withColumn("spots", F.filter(F.transform("t", lambda x, i: F.when(F.array_contains(words, x), i)), lambda i: i.isNotNull()))
    spans = F.expr("flatten(transform(spots, i -> transform(filter(at, s -> s.word = t[i]), s -> struct(i as spot, s.place as place, s.n as n, greatest(i - s.place, 0) as start, least(i - s.place + s.n, size(t)) - 1 as last))))")
    whole = F.expr(f"if(path rlike '{LICENCE_FILE.replace(chr(92), chr(92) * 2)}' and size(t) > 0, array(struct(-1 as spot, 0 as place, 0 as n, 0 as start, size(t) - 1 as last)), array())")
    units = units.withColumn("at", at).withColumn("u", F.explode(F.concat(spans, whole)))
    start, last = F.col("u.start"), F.col("u.last")
    before = F.slice("t", F.greatest(start - 1, F.lit(1)), F.greatest(F.col("u.spot") - F.greatest(start - 2, F.lit(0)), F.lit(0)))
    units = units.withColumn("denied", F.arrays_overlap(before, F.array(*map(F.lit, DENIALS))))
    inside, near = F.slice("t", start + 1, last - start + 1), F.slice("t", start + 1, last - start + 1 + LOOK)
    fits = F.filter(_marks(templates), lambda m: (F.size(F.array_except(m["needs"], inside)) == 0) & ~F.arrays_overlap(m["bars"], near))
    units = saved(units.where("not denied").select("key", "path", "t", "u", F.transform(fits, lambda m: m["template"]).alias("fits")), "units")
    terms = units.select("key", "u.spot", "u.place", "u.n", F.explode(F.expr("transform(sequence(u.start, u.last), q -> t[q])")).alias("term"))
    unit = ["key", "spot", "place", "n"]
    terms = saved(terms.groupBy(*unit, "term").agg(F.count("*").alias("tf")), "terms")
    idf = saved(w.select("term", "idf").distinct(), "idf")
    tf = terms.join(hinted(idf), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", unseen))
    norm = tf.groupBy(*unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = tf.join(hinted(w.select("template", "licence", "term", "w")), "term").groupBy(*unit, "template", "licence").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    cosine = dot.join(norm, unit).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= least)
    fit = units.select("key", "u.spot", "u.place", "u.n", F.explode("fits").alias("template")).distinct()
    cosine = cosine.join(fit, [*unit, "template"], "left_semi")
    # The best licence at each place, unless the next comes close to it there.
    by = cosine.groupBy("key", "spot", "licence").agg(F.max("cosine").alias("cosine")).groupBy("key", "spot")
    by = by.agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("below"), "licence"))).alias("l"))
    first, second = F.get("l", F.lit(0)), F.get("l", F.lit(1))
    clear = second.isNull() | (second["below"] - first["below"] >= margin)
    places = by.select("key", F.when(clear, F.struct(first["below"].alias("below"), first["licence"].alias("licence"))).alias("b"))
    own = saved(places.groupBy("key").agg(F.min("b").alias("b")).select("key", F.col("b.licence").alias("own"), (-F.col("b.below")).alias("cosine"), F.lit(True).alias("said")), "own")
    # Only rows that may announce something meet the table of what does.
    none = (F.lit(None).cast("string").alias("own"), F.lit(None).cast("double").alias("cosine"), F.lit(False).alias("unknown"))
    unknown = F.coalesce("said", F.lit(False)) & F.col("own").isNull()
    rows = files.where(asks).select("row", "path", "key").join(hinted(own), "key", "left").select("row", "path", "own", "cosine", unknown.alias("unknown"))
    rows = rows.unionByName(files.where(~asks).select("row", "path", *none))
    rows = saved(rows.withColumn("folder", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), "")), "rows")

    licences = rows.where(F.col("own").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy("folder").agg(F.min_by(F.struct("own", "path"), F.struct(-F.col("cosine"), F.col("path"), F.col("own"))).alias("f"))
    licences = saved(licences.select(F.col("folder").alias("above"), F.col("f.own").alias("its"), F.col("f.path").alias("from_path")), "licences")
    # Each directory, not each file, looks for the nearest one above it by equality of paths.
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))
    folders = rows.where("own is null and not unknown and folder is not null").select("folder").distinct()
    nearest = folders.select("folder", F.inline(above)).join(hinted(licences), "above").groupBy("folder").agg(F.max_by(F.struct("its", "from_path"), "depth").alias("f"))
    nearest = saved(nearest.select(F.col("folder").alias("its_folder"), "f.*"), "nearest")
    out = rows.join(hinted(nearest), F.col("own").isNull() & ~F.col("unknown") & (F.col("folder") == F.col("its_folder")), "left")
    how = F.when(F.col("own").isNotNull(), "own").when(F.col("unknown"), "unknown").when(F.col("its").isNotNull(), "inherited").otherwise("none")
    return out.select("row", "path", "own", "cosine", F.coalesce("own", "its").alias("licence"), F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("from_path")).alias("from_path"), how.alias("how"))


def laid_out(docs: DataFrame) -> DataFrame:
    """doc_id, path, text of documents as a tree: source/lang/d<doc_id div 50>, the first of each folder its LICENSE."""
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.concat(F.lit("d"), F.expr("doc_id div 50").cast("string")), name).alias("path"), "text")
