"""Licence scan: a trained paragraph classifier confirmed by template comparison, in DataFrame functions only.

Training rows are made from the templates below: copies that lost a few words belong to the
family; copies that lost most words, sentences that merely mention a licence and sentences that use its words for
other things are unknown. A multinomial logistic regression over
sparse word 1- to 3-grams (each with a licence word in it) learns the families; on held-out
copies the classes that are no family's are calibrated, so that of their copies at most ``FALSE_RATE`` pass as a family.
A paragraph without a feature is unknown by construction, so paragraphs without any licence word are not
looked at further. What is predicted as a family must also hold most n-grams of one of its templates.

A paragraph is a line, or a window over neighbouring lines without an empty one among them, so notices that
are wrapped are found: windows begin and end at lines with a licence word or beside one and reach as far as a notice of the longest
template can. Of a family's confirmed windows as many count as do not overlap. Headings such as ``MIT License`` and SPDX tags are too short to be
learned; a line that is one, as a whole, names its families with confidence 1. A grant that is denied (``not licensed
under``), past (``formerly released under``), forbidden (``cannot use this under``), another's (``unlike projects released under``) or asked
for is no grant: the words that say so, over line ends too, become a mark on the line of what they speak of, and a
paragraph with the mark is unknown.

Grants of licences that are no family's are a class of their own, learned from a list of such licences and meant for all
others; it has no template, so it is never confirmed and its texts come out as ``unknown``, as do tags of other identifiers.

The model depends on the templates only; it is trained once for each Spark application, on one cached partition.

The weights and template n-grams come from the templates alone, so their size does not
depend on the corpus; they are the only data that are broadcast.

Defined results: null, empty and licence-free texts have licence ``none``; a text with several
families names them all in alphabetical order; a line without a letter or digit counts as empty; an SPDX tag counts once for each of its families; rows with null or repeated ids are scanned
row by row; other columns are ignored; an empty table gives an empty result. Texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

UNKNOWN, UNLISTED = "unknown", "unlisted"
COPIES, KEEP, LOSE = 48, 0.85, 0.2
FALSE_RATE, SURE, CONFIRM = 0.005, 0.5, 0.6

#: The families' notices.
TEMPLATES = {
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied"),
    "BSD": ("Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "Artistic-2.0": ("Licensed under the Artistic License 2.0.", "You may use and distribute it under the terms of the Artistic License, version 2.0"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "Use, modification and distribution are subject to the Boost Software License, Version 1.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights and dedicated this work to the public domain"),
    "EPL-2.0": ("Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    "EUPL-1.2": ("Licensed under the EUPL, Version 1.2.", "Provided under the terms of the European Union Public Licence, version 1.2 or later"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GNU GPL, version 2 or later."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction", "Use of this source code is governed by an MIT-style license"),
    "Unlicense": ("Released under the Unlicense.", "This is free and unencumbered software released into the public domain"),
    "WTFPL": ("Licensed under the WTFPL, version 2.", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    "Zlib": ("Licensed under the zlib License.", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
}
#: Lines that name a family when nothing else stands in them, as patterns over words with one blank between.
HEADINGS = {
    "AGPL-3.0": "gnu affero general public license( (version 3|v3))?",
    "Apache-2.0": "(the )?apache (software )?license( (version 2( 0)?|2 0|v2))?( january 2004)?",
    "Artistic-2.0": "(the )?artistic license( (version )?2( 0)?)?",
    "BSD": "(the )?([0-9] clause )?((new|modified|simplified|revised) )?bsd( [0-9] clause)?( (new|modified|simplified|revised))? license",
    "BSL-1.0": "(the )?boost software license( (version )?1 0)?",
    "CC-BY": "(creative commons )?(attribution|cc by) 4 0( international)?( license)?",
    "CC-BY-NC": "(creative commons )?(attribution noncommercial|cc by nc) 4 0( international)?( license)?",
    "CC-BY-ND": "(creative commons )?(attribution noderivatives|cc by nd) 4 0( international)?( license)?",
    "CC-BY-SA": "(creative commons )?(attribution sharealike|cc by sa) 4 0( international)?( license)?",
    "CC0": "(creative commons )?cc0 1 0( universal)?",
    "EPL-2.0": "(the )?eclipse public license( (version|v))?( 2 0)?",
    "EUPL-1.2": "(the )?(european union public licence|eupl)( (version|v))?( 1 2)?",
    "GPL": "(the )?gnu (general public license|gpl)( (version|v) ?[23]( 0)?)?( or later)?",
    "ISC": "(the )?isc license( isc)?",
    "LGPL": "(the )?gnu (lesser|library) general public license( (version|v) ?[23]( [01])?)?( or later)?",
    "MIT": "(the )?(mit|expat) license( mit)?",
    "MPL-2.0": "mozilla public license( (version|v))?( 2 0)?",
    "Unlicense": "(the )?unlicense",
    "WTFPL": "(the )?(wtfpl|do what the fuck you want to public license)( (version )?2)?",
    "Zlib": "(the )?zlib license",
}
#: SPDX identifiers of the families as patterns.
SPDX = {
    "AGPL-3.0": "agpl-3[^ ]*", "Apache-2.0": "apache-2[^ ]*", "Artistic-2.0": "artistic-2[^ ]*", "BSD": "bsd-[0-9][^ ]*", "BSL-1.0": "bsl-1[^ ]*", "CC-BY": "cc-by-[0-9][^ ]*", "CC-BY-NC": "cc-by-nc-[0-9][^ ]*",
    "CC-BY-ND": "cc-by-nd-[0-9][^ ]*", "CC-BY-SA": "cc-by-sa-[0-9][^ ]*", "CC0": "cc0-1[^ ]*", "EPL-2.0": "epl-2[^ ]*", "EUPL-1.2": "eupl-1[^ ]*", "GPL": "gpl-[0-9][^ ]*", "ISC": "isc", "LGPL": "lgpl-[0-9][^ ]*",
    "MIT": "mit", "MPL-2.0": "mpl-2[^ ]*", "Unlicense": "unlicense", "WTFPL": "wtfpl", "Zlib": "zlib",
}
#: Words of the notices that say nothing about licences.
PLAIN = frozenset("a all an and any are as at be by can charge conditions either except extent fee following for form forms free from has implied in is it kind later law not of on or other person provided purpose related style that the this to under use v version waived with without work you may copy file files author deal met possible possible library program public accompanying any arising damages do event held held in liable materials no use want what will work works allowed changed changing everyone into long made name".split())
#: Licence words that are common words elsewhere (German ``mit``) or mere letters. They count in features, but do not mark a line: no notice has only them.
WEAK = frozenset("mit nc nd sa".split())
#: Sentences that use such words for other things.
OTHERS = ("The driver renewed the licence at the office.", "The public library keeps the source of the general rule.", "Warranties were discussed and terms were set.", "The foundation published a notice about its software.", "He studied at MIT and moved to Berkeley.", "The Mozilla browser and the Apache server were installed.", "GNU tools are distributed with the system.", "Creative people share the international stage.", "A copyright dispute about the song was settled.", "Permission was granted to leave the room.")
#: The families' names, and sentences that mention one of them without granting it.
NAMES = {
    "AGPL-3.0": "GNU Affero General Public License", "Apache-2.0": "Apache License", "Artistic-2.0": "Artistic License", "BSD": "BSD License", "BSL-1.0": "Boost Software License", "CC-BY": "Creative Commons Attribution license",
    "CC-BY-NC": "CC BY-NC license", "CC-BY-ND": "CC BY-ND license", "CC-BY-SA": "CC BY-SA license", "CC0": "CC0 dedication", "EPL-2.0": "Eclipse Public License", "EUPL-1.2": "European Union Public Licence", "GPL": "GNU General Public License",
    "ISC": "ISC License", "LGPL": "GNU Lesser General Public License", "MIT": "MIT License", "MPL-2.0": "Mozilla Public License", "Unlicense": "Unlicense", "WTFPL": "WTFPL", "Zlib": "zlib License",
}
MENTIONS = ("The talk compared the {} with other texts.", "He wrote a paper about the {}.", "A history of the {} was printed last year.", "Lawyers argued over the {} in court.", "They discussed the {} and its terms at the meeting.")
#: Grants of licences that are no family's, as forms and names.
GRANTS = ("Licensed under the {}.", "Released under the {}, version 2.", "This software is distributed under the terms of the {}.", "Use of this source code is governed by the {}.")
UNLISTED_NAMES = (
    "Academic Free License", "PHP License", "Ruby License", "Python Software Foundation License", "Microsoft Public License", "Open Software License", "OpenLDAP Public License", "Common Development and Distribution License",
    "License", "Public License", "Open Source License", "Software License", "Sleepycat License", "Vim License", "SIL Open Font License", "Community Data License Agreement", "Server Side Public License", "Elastic License", "Business Source License", "Acme Corporation Proprietary License",
)
#: Words of a grant up to the word before the licence, over at most one line end each.
_GRANT = r"(?:licen[sc]ed|released|distributed|available|covered|offered|published|provided)\s+(?:under|by|with)\s+"
#: Grants that are denied or past, forbidden, another's, and asked for; and the mark that replaces them.
DENIALS = (
    r"(?:not|never|no longer|neither|isn't|wasn't|nor|formerly|previously|once|originally|used to be)\s+(?:\w+\s+){0,3}?" + _GRANT,
    r"(?:cannot|can't|can not|may not|must not|mustn't|do not|don't)\s+(?:use|copy|modify|distribute|redistribute|share|release|publish)\s+(?:(?!except\b|unless\b)\w+\s+){0,4}?under\s+",
    r"unlike\s+(?:[\w'-]+\s+){0,6}?" + _GRANT,
    r"(?:is|are|was|were|be|do|does|can|could|should|may)\s+(?:[\w'-]+\s+){0,6}?" + _GRANT + r"(?=[^.?!\n]{0,120}(?:\n[^.?!\n]{0,120})?\?)",
)
DENIAL = rf"(?i)\b(?:{'|'.join(DENIALS)})"
DENIED = "grantdenied"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def licence_words() -> list[str]:
    """The words of the templates that may mark a feature."""
    import re

    return sorted({w for notices in TEMPLATES.values() for t in notices for w in re.split("[^a-z0-9]+", t.lower()) if len(w) > 1 and w not in PLAIN and not w.isdigit()})


def longest() -> int:
    """Words of the longest template."""
    import re

    return max(len(re.findall("[a-z0-9]+", t.lower())) for notices in TEMPLATES.values() for t in notices)


def grams(text: Column) -> Column:
    """Distinct word 1- to 3-grams that hold a licence word."""
    return grams_of(words(text))


def grams_of(w: Column) -> Column:
    marks = F.array(*map(F.lit, licence_words()))
    two = F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b))
    three = F.zip_with(F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b)), F.slice(w, 3, 1 << 30), lambda a, b: F.concat_ws(" ", a, b))
    return F.filter(F.array_distinct(F.concat(w, two, three)), lambda g: F.arrays_overlap(F.split(g, " "), marks))


@dataclass
class Model:
    """The classes in order (the last two are no family's), the intercepts, the offset of those two, and the n-gram tables."""

    classes: list[str]
    intercepts: list[float]
    offset: float
    weights: DataFrame
    templates: DataFrame


def training_rows(spark: SparkSession) -> DataFrame:
    """label, copy and text: the templates' copies that lost a few or most words, and the other sentences'."""
    other = [*OTHERS, *(m.format(NAMES[f]) for f in sorted(NAMES) for m in MENTIONS)]
    rows = [(family, t) for family, notices in TEMPLATES.items() for t in notices] + [(UNLISTED, g.format(x)) for x in UNLISTED_NAMES for g in GRANTS] + [(UNKNOWN, t) for t in other]
    base = spark.createDataFrame(rows, "label string, notice string").coalesce(1).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2 * COPIES - 1))))
    few = F.col("copy") < COPIES
    # a mention is the same for every family: few copies say so; what is left of a grant of any licence is no class's
    base = base.where((F.col("label") != UNKNOWN) | (F.col("copy") % 8 < 2)).where((F.col("label") != UNLISTED) | (F.col("copy") < COPIES))
    share = F.when(F.col("copy") % COPIES == 0, F.when(few, 1.0).otherwise(0.0)).when(few, KEEP).otherwise(LOSE)
    kept = F.filter(words(F.col("notice")), lambda w, i: F.pmod(F.xxhash64(w, i, "copy", "notice"), F.lit(1000)) < share * 1000)
    return base.select(F.when(few, F.col("label")).otherwise(UNKNOWN).alias("label"), "copy", F.array_join(kept, " ").alias("text"))


#: The learned numbers by Spark application.
_TRAINED: dict[str, tuple] = {}


def fit(spark: SparkSession) -> Model:
    """The trained model; its numbers are learned once for each application."""
    key = spark.sparkContext.applicationId
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = _learned(spark)
    vocabulary, matrix, intercepts, offset = _TRAINED[key]
    classes = [*sorted(TEMPLATES), UNLISTED, UNKNOWN]
    weights = spark.createDataFrame([(g, row) for g, row in zip(vocabulary, matrix, strict=True)], "gram string, w array<double>")
    notices = spark.createDataFrame([(f"{family} {k}", family, t) for family, texts in TEMPLATES.items() for k, t in enumerate(texts)], "template string, family string, notice string").coalesce(1)
    held_grams = notices.withColumn("gs", grams(F.col("notice"))).select("template", "family", F.size("gs").alias("n"), F.explode("gs").alias("gram"))
    return Model(classes, intercepts, offset, weights, held_grams)


def _learned(spark: SparkSession) -> tuple[list[str], list[list[float]], list[float], float]:
    """The vocabulary, each n-gram's weights by class, the intercepts and the offset of the classes that are no family's."""
    rows = training_rows(spark).withColumn("grams", grams(F.col("text")))
    classes = [*sorted(TEMPLATES), UNLISTED, UNKNOWN]
    place = F.create_map(*(x for k, c in enumerate(classes) for x in (F.lit(c), F.lit(float(k)))))
    rows = rows.withColumn("y", place[F.col("label")]).select("label", "copy", "grams", "y").cache()
    learn, held = rows.where("copy % 4 != 1"), rows.where("copy % 4 = 1")
    vectorizer = CountVectorizer(inputCol="grams", outputCol="x", binary=True, minDF=2, vocabSize=1 << 14).fit(learn)
    model = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=0.001, maxIter=40).fit(vectorizer.transform(learn))
    last = len(classes) - 1
    raw = model.transform(vectorizer.transform(held.where(F.col("label").isin(UNKNOWN, UNLISTED)))).select(vector_to_array("rawPrediction").alias("r"))
    margin = F.array_max(F.slice("r", 1, last - 1)) - F.greatest(F.col("r")[last - 1], F.col("r")[last])
    least = raw.agg(F.percentile(margin, 1 - FALSE_RATE)).first()[0] or 0.0
    rows.unpersist()
    # the empty paragraph must be unknown too
    intercepts = [float(x) for x in model.interceptVector]
    intercepts[last - 1] = min(intercepts[last - 1], intercepts[last] - 0.1)
    offset = max(0.0, least, max(intercepts[: last - 1]) - intercepts[last])
    return list(vectorizer.vocabulary), model.coefficientMatrix.toArray().T.tolist(), intercepts, offset


def calibration(spark: SparkSession, model: Model) -> DataFrame:
    """How sure and how right the model is on the held-out copies: tenth of the score, number, and share whose class is right."""
    rows = training_rows(spark).where("copy % 4 = 1").withColumn("doc_id", F.monotonically_increasing_id())
    seen = classified(rows.select("doc_id", "text"), model).where("line IS NOT NULL").groupBy("doc_id").agg(F.max_by("family", "score").alias("family"), F.max("score").alias("score"))
    return rows.select("doc_id", "label").join(seen, "doc_id").groupBy(F.floor(F.col("score") * 10).alias("tenth")).agg(F.count("*").alias("n"), F.avg((F.col("family") == F.col("label")).cast("int")).alias("right"))


def named(line: Column) -> Column:
    """The families of a line that is a heading or holds an SPDX tag; a tag of another identifier is unlisted."""
    whole = F.array_join(words(line), " ")
    tag = F.regexp_replace(F.regexp_extract(F.lower(line), r"spdx-license-identifier:\s*(.*)", 1), "[^a-z0-9.+-]+", " ")
    other = F.when((F.trim(tag) != "") & ~tag.rlike(f"(?:^| )(?:{'|'.join(SPDX[f] for f in sorted(TEMPLATES))}|none|noassertion)(?: |$)"), F.lit(UNLISTED))
    return F.array_compact(F.array(other, *(F.when(whole.rlike(f"^(?:{HEADINGS[f]})$") | tag.rlike(f"(?:^| )(?:{SPDX[f]})(?: |$)"), F.lit(f)) for f in sorted(TEMPLATES))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, row, first and last line, n-grams, and families by name of the paragraphs that begin and end at a licence word's line or beside one; a document without one has a single row without lines.

    Lines between the first and the last one belong to the notice as a whole, so they have fewer words than
    the longest template, and of the first and last line that many words are enough.
    """
    n = longest()
    # texts without a licence word are not split
    lines = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.when(has_mark(F.col("text")), F.split(F.regexp_replace("text", DENIAL, f"{DENIED} "), "\n")).alias("lines"))
    marked = lines.withColumn("flags", F.transform("lines", has_mark))
    sizes = marked.withColumn("sizes", F.when(F.array_contains("flags", True), F.transform("lines", lambda t: F.size(words(t)))))
    flag = lambda i: F.coalesce(F.get("flags", i), F.lit(False))
    sizes = sizes.withColumn("marks", F.array_compact(F.transform("sizes", lambda size, i: F.when((size > 0) & (flag(i - 1) | flag(i) | flag(i + 1)), i))))
    none = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("words"), F.lit(True).alias("on"))

    def further(at: Column, size: Column) -> Column:
        on = at["on"] & (size > 0) & (at["words"] < n)
        return F.struct((at["lines"] + on.cast("int")).alias("lines"), (at["words"] + size).alias("words"), on.alias("on"))

    def near(i: Column, k: Column) -> Column:
        reach = F.aggregate(F.slice("sizes", i + 2, F.lit(n)), none, further)["lines"]
        ends = F.filter(F.transform(F.slice("marks", k + 1, F.lit(n + 1)), lambda j: j - i), lambda d: (d <= reach) & ((d > 0) | flag(i)))
        return F.struct(i.alias("line"), F.slice("lines", i + 1, F.array_max(ends) + 1).alias("near"), ends.alias("ends"))

    each = sizes.select("doc_id", "row", F.explode_outer(F.transform("marks", near)).alias("p")).select("doc_id", "row", "p.line", "p.ends", F.transform("p.near", words).alias("near"), named(F.col("p.near")[0]).alias("named"))
    ends = each.select("doc_id", "row", "line", "near", "named", F.explode_outer("ends").alias("end")).where("line IS NULL OR end IS NOT NULL")
    tail, head = F.slice(F.col("near")[0], F.greatest(F.lit(1), F.size(F.col("near")[0]) - n + 1), F.lit(n)), F.slice(F.get("near", F.col("end")), 1, n)
    window = F.when(F.col("end") == 0, F.col("near")[0]).otherwise(F.concat(tail, F.flatten(F.slice("near", F.lit(2), F.col("end") - 1)), head))
    return ends.select("doc_id", "row", "line", (F.col("line") + F.col("end")).alias("last"), F.when(~F.array_contains(window, DENIED), grams_of(window)).alias("grams"), F.when((F.col("end") == 0) & ~F.array_contains(F.col("near")[0], DENIED), F.col("named")).alias("named"))


def has_mark(text: Column) -> Column:
    """Whether a licence word occurs; the words are grouped by their first letter, so most places are passed at once."""
    groups: dict[str, list[str]] = {}
    for word in licence_words():
        if word in WEAK:
            continue
        groups.setdefault(word[0], []).append(word[1:])
    return F.lower(text).rlike(f"(?<![a-z0-9])(?:{'|'.join(f'{k}(?:{"|".join(v)})' for k, v in groups.items())})(?![a-z0-9])")


def classified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row, line, last, family (or unknown), score and confirmed of every paragraph with a licence word, and of one without a line for other documents; paragraphs by name have a row for each family."""
    key = ["doc_id", "row", "line", "last"]
    parts = cut(paragraphs(docs))
    found = parts.select(*key, F.explode_outer("grams").alias("gram"))
    count = len(model.classes)
    sums = found.join(F.broadcast(model.weights), "gram", "left").groupBy(*key).agg(*(F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(count)))
    scores = F.array(*(F.col(f"s{k}") + F.lit(model.intercepts[k] + (model.offset if k >= count - 2 else 0.0)) for k in range(count)))
    scored = sums.select(*key, scores.alias("scores")).withColumn("top", F.array_max("scores"))
    names = F.array(*map(F.lit, model.classes))
    total = F.aggregate(F.transform("scores", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    named = scored.select(*key, F.element_at(names, F.array_position("scores", F.col("top")).cast("int")).alias("family"), (1 / total).alias("score"))
    known = named.withColumn("family", F.when(F.col("score") >= SURE, F.col("family")).otherwise(UNKNOWN))
    held = found.join(F.broadcast(model.templates.withColumnRenamed("family", "of")), "gram").groupBy(*key, "template", "of").agg((F.count("*") / F.max("n")).alias("share"))
    best = held.groupBy(*key, F.col("of").alias("family")).agg(F.max("share").alias("share"))
    joined = known.alias("k").join(best.alias("b"), [*(F.col(f"k.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key), F.col("k.family") == F.col("b.family")], "left")
    by_name = parts.select(*key, F.explode("named").alias("family"), F.lit(1.0).alias("score")).withColumn("confirmed", F.col("family") != UNLISTED)
    return joined.select(*(f"k.{c}" for c in key), "k.family", "score", (F.coalesce("share", F.lit(0.0)) >= CONFIRM).alias("confirmed")).unionByName(by_name)


def _apart(windows: Column) -> Column:
    """The number of windows that hold no other one and do not overlap; ``windows`` are sorted by their last first line, then by their last line.

    Going back, the window that ends first among those behind a place is taken, so each step needs the begin of the one taken before only.
    """
    start = F.struct(F.lit(1 << 31).cast("long").alias("begin"), F.lit(0).cast("long").alias("n"))

    def step(at: Column, w: Column) -> Column:
        free = w["last"] < at["begin"]
        return F.struct(F.when(free, -w["back"]).otherwise(at["begin"]).cast("long").alias("begin"), (at["n"] + free.cast("long")).alias("n"))

    return F.aggregate(windows, start, step)["n"]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, licence, confidence and n_notices of every document.

    ``licence`` names the confirmed families; ``unknown`` means that a paragraph was predicted to
    be of a family, or of a licence that is none's, and none was confirmed; ``none`` is everything else.
    """
    model = model or fit(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = classified(rows, model)
    said = F.col("family") != UNKNOWN
    # a document's paragraphs that count are as many as its lines at most
    of_family = seen.groupBy("doc_id", "row", "family").agg(F.array_sort(F.collect_set(F.when(F.col("confirmed") & said, F.struct((-F.col("line")).alias("back"), "last")))).alias("windows"), F.max(F.when(F.col("confirmed") & said, F.col("score"))).alias("score"))
    counted = of_family.withColumn("n", _apart(F.col("windows")))
    of_row = counted.groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.col("family")))).alias("families"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("confidence"),
        F.sum("n").alias("n_notices"),
        F.coalesce(F.max(said), F.lit(False)).alias("said"),
    )
    licence = F.when(F.size("families") > 0, F.array_join("families", ",")).when(F.col("said"), F.lit(UNKNOWN)).otherwise(F.lit("none"))
    return of_row.select("doc_id", licence.alias("licence"), "confidence", "n_notices")
