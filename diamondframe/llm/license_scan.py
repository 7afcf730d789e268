"""License scans: exact set-similarity join of text blocks with license templates.

A block is a window of a text's words, across line ends: for each template, ``SPAN`` times as
many words as it has, from each of its words on. Blocks and templates are sets of words. A block
contains a template if it holds at least ``THRESHOLD`` of its words and, in order, those that set
the license apart from others (``MARKS``). Only texts that hold as
much of a template are cut into blocks. Those are found by a join: words of the templates are
ordered by how many texts of the corpus hold them, rare ones first, and a text with enough
words of a template holds one of its prefix: its rarest words, one more than may be missing.

* prefix: a text's words meet the prefixes of the templates, a table that is small by nature
  (``TEMPLATES``, or the caller's, at most ``MOST_TEMPLATES``);
* length: the text has enough words of templates at all;
* position: enough words are left, on both sides, from the first common word on;
* then the words in common are counted, in the text and in its blocks.

What a text contains follows from its words alone: blocks of equal texts are reduced to one set
before the shuffle, and go back to all rows of the text by its hashes. Phrases are counted
beside that, in the whole text. Columns and rows only.

Defined results: a missing or empty text has no words and no license; a missing doc_id stays
missing; repeated rows get equal results; an empty table gives an empty table; only
doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from diamondframe.llm.common import read_table, text_value
from diamondframe.session import written

THRESHOLD, MOST_TEMPLATES = 0.8, 10_000
#: Words of a block for each word of a template.
SPAN = 2

# Phrases and notices of common licenses.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
TEMPLATES = (
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met:"),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License."),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("gpl-2.0", "GNU General Public License Version 2, June 1991"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms "
                "of the GNU General Public License as published by the Free Software Foundation; either "
                "version 2 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms "
                "of the GNU General Public License as published by the Free Software Foundation, either "
                "version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "MIT License Copyright (c)"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
    ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("lgpl-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
)
# End of the fixed values.

#: What sets a license apart from others whose notices share most of its words, by label: a pattern
#: over a block's words, each between single blanks. A block without it does not contain the template.
_VERSION = "(version |v )?v?"
_SPDX = " spdx licen[cs]e identifier "
#: What stands between the name and the version in the notice of a file.
_PUBLISHED = "(as published by the free software foundation (either )?)?"
MARKS = {
    "agpl-3.0": f" gnu affero general public licen[cs]e (agpl )?{_VERSION}3 |{_SPDX}agpl 3 0 ",
    "apache-2.0": f" apache licen[cs]e {_VERSION}2 0 |{_SPDX}apache 2 0 ",
    "bsd-2-clause": " bsd 2 clause | 2 clause bsd ",
    "bsd-3-clause": " bsd 3 clause | 3 clause bsd ",
    "cc-by-4.0": f" creative commons attribution {_VERSION}4 0 | cc by {_VERSION}4 0 ",
    "cc-by-nc-4.0": f" cc by nc {_VERSION}4 0 ",
    "cc-by-nc-nd-4.0": f" cc by nc nd {_VERSION}4 0 ",
    "cc-by-nc-sa-4.0": f" cc by nc sa {_VERSION}4 0 ",
    "cc-by-nd-4.0": f" cc by nd {_VERSION}4 0 ",
    "cc-by-sa-4.0": f" cc by sa {_VERSION}4 0 ",
    "cc0-1.0": " cc0 ",
    "gpl-2.0": f" gnu general public licen[cs]e (gpl )?{_PUBLISHED}{_VERSION}2 |{_SPDX}gpl 2 0 ",
    "gpl-3.0": f" gnu general public licen[cs]e (gpl )?{_PUBLISHED}{_VERSION}3 |{_SPDX}gpl 3 0 ",
    "lgpl-3.0": f" gnu lesser general public licen[cs]e (lgpl )?{_VERSION}3 |{_SPDX}lgpl 3 0 ",
    "mit": rf" mit (?!0 )(\S+ ){{0,2}}licen[cs]e (?!identifier )| permission is hereby granted |{_SPDX}mit ",
    "mpl-2.0": f" mozilla public licen[cs]e (mpl )?{_VERSION}2 0 |{_SPDX}mpl 2 0 ",
}

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    # The sign of the kelvin would become the letter k, and is no letter of A to Z.
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138"))), SEPARATOR + "+"), "")


def _template_words(text: str) -> list[str]:
    return sorted({w for w in re.split(SEPARATOR + "+", text.lower()) if w})


def _places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand one after the other; looked for where all of them are."""
    parts = phrase.split()
    n = F.size(words)
    there = reduce(lambda x, y: x & y, [F.array_contains(words, p) for p in sorted(set(parts), key=len, reverse=True)])
    starts = F.filter(
        F.sequence(F.lit(0), n - len(parts)),
        lambda i: reduce(lambda x, y: x & y, [F.get(words, i + k) == p for k, p in enumerate(parts)]),
    )
    return F.when(there & (n >= len(parts)), starts).otherwise(F.array().cast("array<int>"))


def base_columns(rows: DataFrame, phrases=PHRASES) -> DataFrame:
    """``rows`` with n_words, n_base, first_word, last_word and base_labels from their ``words``."""
    places = {f"_p{n}": _places(F.col("words"), phrase) for n, (phrase, _) in enumerate(phrases)}
    found = rows.withColumn("n_words", F.size("words").cast("long")).withColumns(places).drop("words")
    every = F.concat(*places) if places else F.array().cast("array<int>")
    labels = F.array_compact(F.array(*[
        F.when(F.size(name) > 0, F.lit(label)) for name, (_, label) in zip(places, phrases)
    ]).cast("array<string>"))
    return found.withColumns({
        "n_base": F.size(every).cast("long"), "first_word": F.array_min(every).cast("long"),
        "last_word": F.array_max(every).cast("long"), "base_labels": F.array_sort(F.array_distinct(labels)),
    }).drop(*places)


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("v1"), F.xxhash64(F.lit("second"), text).alias("v2")]


def _texts(docs: DataFrame) -> DataFrame:
    text = text_value()
    return docs.select(*_hashes(text), words(text).alias("words"))


def _ordered_words(texts: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words by the number of texts that hold them; the words are the templates' own."""
    known = F.array(*map(F.lit, vocabulary))
    counted = texts.select(F.explode(F.array_intersect(known, "words")).alias("word")).groupBy("word")
    n = {r["word"]: r["n"] for r in counted.agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _contained(template: Column, words: Column, need: Column, span: Column, mark: Column) -> Column:
    """(at, end, common) of the blocks that contain a template, by their first word."""
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(template, F.get(words, i)))
    blocks = F.transform(starts, lambda i: F.struct(
        i.alias("at"), (i + span).alias("end"), F.array_intersect(template, F.slice(words, i + 1, span)).alias("common")
    ))
    enough = F.filter(blocks, lambda b: F.size(b["common"]) >= need)

    def marked(block: Column) -> Column:
        of_block = F.slice(words, block["at"] + 1, span)
        return F.rlike(F.concat(F.lit(" "), F.array_join(of_block, " "), F.lit(" ")), mark)

    return F.filter(enough, lambda b: mark.isNull() | marked(b))


def contained_templates(
    docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, marks=MARKS
) -> DataFrame:
    """(v1, v2, at, end, common, label, containment) for every block and template that it contains.

    v1 and v2 are hashes of the text; equal texts are taken once.
    """
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    sets = [(label, _template_words(text), text) for label, text in templates]
    sets = [(label, found, text) for label, found, text in sets if found]
    texts = _texts(docs)
    order = _ordered_words(texts, sorted({w for _, found, _ in sets for w in found}))
    rank = {w: n for n, w in enumerate(order)}
    prefixes = []
    for label, found, text in sets:
        ranked = sorted(found, key=rank.get)
        need = math.ceil(threshold * len(ranked) - 1e-9)
        span = SPAN * len([w for w in re.split(SEPARATOR + "+", text) if w])
        prefixes += [
            (w, at, label, need, span, marks.get(label), ranked) for at, w in enumerate(ranked[: len(ranked) - need + 1])
        ]
    table = docs.sparkSession.createDataFrame(
        prefixes, "word string, at int, label string, need int, span int, mark string, template array<string>"
    )
    # The words of templates in a text, rare ones first.
    ranked = texts.select("*", F.array_intersect(F.array(*map(F.lit, order)), "words").alias("known")).filter(
        F.size("known") >= min(need for _, _, _, need, *_ in prefixes)
    )
    placed = ranked.select("*", F.posexplode("known").alias("known_at", "word"))
    left = F.least(F.size("template") - F.col("at"), F.size("known") - F.col("known_at"))
    candidates = placed.join(F.broadcast(table), "word").filter(
        (F.size("known") >= F.col("need")) & (left >= F.col("need"))
    )
    common = F.array_intersect("template", "known")
    # A pair is taken at its first common word, so once.
    pairs = candidates.filter((F.get(common, F.lit(0)) == F.col("word")) & (F.size(common) >= F.col("need")))
    blocks = _contained(F.col("template"), F.col("words"), F.col("need"), F.col("span"), F.col("mark"))
    return pairs.select("v1", "v2", "label", "template", F.explode(blocks).alias("block")).select(
        "v1", "v2", "block.*", "label", (F.size("block.common") / F.size("template")).alias("containment")
    ).distinct()


def license_scan(
    docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, marks=MARKS
) -> DataFrame:
    """doc_id, the counts of phrases, ``base_labels``, ``labels`` and ``score`` of every row.

    A text gives the labels of all templates that its blocks contain, but for those whose words are
    among the words of a better contained one in the same place. The score is 1 where a phrase was
    found, else the best containment over the threshold, else 0.
    """
    pairs = contained_templates(docs, templates, threshold, marks)
    # Blocks that meet are in one place.
    widest = SPAN * max((len(re.split(SEPARATOR + "+", text)) for _, text in templates), default=0)
    near = Window.partitionBy("v1", "v2").orderBy("at").rangeBetween(-widest, widest)
    others = F.collect_set(F.struct("at", "end", "common", "containment")).over(near)
    better = F.exists("others", lambda o: (
        (o["containment"] > F.col("containment")) & (o["at"] < F.col("end")) & (F.col("at") < o["end"])
        & (F.size(F.array_except("common", o["common"])) == 0)
    ))
    best = pairs.withColumn("others", others).filter(~better)
    found = written(
        best.groupBy("v1", "v2")
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment")),
        "licenses",
    )
    text = text_value()
    rows = base_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_hashes(text), words(text).alias("words")), phrases)
    labels = F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>")))
    return rows.join(found, ["v1", "v2"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op7_license_scan(spark, sf_dir):
    return license_scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_license_scan": op7_license_scan}
