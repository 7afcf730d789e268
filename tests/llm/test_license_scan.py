from __future__ import annotations

import math
import random
import re
import textwrap
from collections import Counter

import pytest
from conftest import SF

from __spark_entry__ import queries
from diamondframe.llm.license_scan import MARKS, PHRASES, TEMPLATES, contained_templates, license_scan

from llm.brute import COLUMNS, edge_rows, fold

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LINE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def base(text, phrases=PHRASES):
    words, starts, labels = WORD.findall(fold(text)), [], set()
    for phrase, label in phrases:
        parts = phrase.split()
        for at in range(len(words) - len(parts) + 1):
            if words[at : at + len(parts)] == parts:
                starts.append(at)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), labels


def scanned(text, threshold=0.8, templates=TEMPLATES, marks=MARKS):
    """The rule itself: every window of every template, then those inside better ones go."""
    n, n_base, first, last, labels = base(text)
    words, blocks = LINE_WORD.findall((text or "").lower()), []
    widest = 2 * max(len(LINE_WORD.findall(t)) for _, t in templates)
    for label, template in templates:
        own = set(LINE_WORD.findall(template.lower()))
        span, need = 2 * len(LINE_WORD.findall(template)), math.ceil(threshold * len(own) - 1e-9)
        if len(own & set(words)) < need:
            continue
        for at, word in enumerate(words):
            block = words[at : at + span]
            common = own & set(block)
            mark = marks.get(label)
            if word in own and len(common) >= need and (not mark or re.search(mark, f" {' '.join(block)} ")):
                blocks.append((at, at + span, common, label, len(common) / len(own)))
    kept = [
        p for p in blocks if not any(
            o[4] > p[4] and o[0] < p[1] and p[0] < o[1] and abs(o[0] - p[0]) <= widest and p[2] <= o[2] for o in blocks
        )
    ]
    found, most = {p[3] for p in kept}, max((p[4] for p in kept), default=0.0)
    score = 1.0 if n_base else most
    return n, n_base, first, last, ",".join(sorted(labels)), ",".join(sorted(labels | found)), round(score, 9)


CASES = [
    "CC BY cc-by CC  BY\nccby cc bye", "General Public\nLicense", "xall rights reserved", "All rights reserved.",
    "All Rights — Reserved", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
    "licensed under the apache licence version 2.0 by us", "Licensed\nunder the Apache License",
    "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
    "Released under the MIT License. " * 3 + "\nLicensed under the BSD 3-Clause License.", "Kill cc by",
    "all rights reserved all rights reserved all rights", "é cc by é cc\x00by", "C\u0421 BY \u212a cc\nby",
    *[textwrap.fill(t, 50) for _, t in TEMPLATES],
]
_made = random.Random(3)
for _ in range(80):
    # Notices that lost, changed or doubled words, several of them close to each other.
    parts = []
    for _, notice in _made.choices(TEMPLATES, k=_made.randrange(1, 4)):
        found = notice.split()
        for _ in range(_made.randrange(0, 4)):
            k = _made.randrange(len(found))
            found[k : k + 1] = _made.choice([[], ["other"], [found[k]] * 2, [found[k], "\n"]])
            found = found or ["gone"]
        parts += found + ["and"] * _made.randrange(0, 9)
    CASES.append(" ".join(parts))


@pytest.fixture(scope="module")
def cases(spark):
    rows = [*edge_rows(), *[(100 + n, t, None, None, 0, 1, "v", 1, "k", "z") for n, t in enumerate(CASES)]]
    return rows, spark.createDataFrame(rows, COLUMNS)


def test_against_brute_force(cases):
    rows, table = cases
    want = Counter((r[0], *scanned(r[1])) for r in rows)
    got = Counter(
        (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
        for r in license_scan(table).collect()
    )
    assert got == want


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries()["op7_license_scan"](spark, SF).collect()}
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == scanned(d.text)


def test_repeated_rows_of_one_licensed_text(spark):
    """Rows without doc_id, and the same text under many: one set of blocks, every row its labels."""
    text = "Released under the MIT License. " + "word " * 30 + "Licensed under CC BY 4.0."
    rows = [(None, text)] * 200 + [(k, text) for k in range(200)] + [(None, "another text"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert contained_templates(docs).count() == contained_templates(docs.limit(0).unionByName(
        spark.createDataFrame([(1, text)], docs.schema))).count() > 1
    got = Counter((r.doc_id, r.labels) for r in license_scan(docs).collect())
    assert got == Counter((i, "cc-by,cc-by-4.0,mit" if t == text else "") for i, t in rows)


def test_empty_table(no_docs):
    assert license_scan(no_docs).collect() == []


def labels_of(spark, texts):
    rows = [(n, t, None, None, 0, 1, "v", 1, "k", "z") for n, t in enumerate(texts)]
    found = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, COLUMNS)).collect()}
    return [(found[n].labels, round(found[n].score, 9)) for n in range(len(texts))]


def test_wrapped_and_scattered_notices(spark):
    bsd, mit = (next(t for _, t in TEMPLATES if t.startswith(w)) for w in ("Redistribution", "Permission"))
    wrapped = [textwrap.fill(t, width) for t in (bsd, mit) for width in (30, 72)]
    wrapped.append("# " + wrapped[0].replace("\n", "\n# "))
    filler = " ".join(f"w{n}" for n in range(200))
    scattered = f" {filler} ".join("Released under the MIT License.".split())
    got = labels_of(spark, [*wrapped, scattered, f"{filler} {wrapped[3]} {filler}"])
    assert got == [("bsd", 1.0)] * 2 + [("mit", 1.0)] * 2 + [("bsd", 1.0), ("", 0.0), ("mit", 1.0)]


def test_marks_and_several_notices(spark):
    texts = {
        "Released under the Apache License.": "", "Released under the GPL license": "",
        "released under the label's own license": "", "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0",
        "Licensed under CC BY-ND 4.0.": "cc-by,cc-by-nd-4.0", "Licensed under CC BY-NC-SA 4.0.": "cc-by,cc-by-nc-sa-4.0",
        "Licensed under the BSD 2-Clause License.": "bsd-2-clause", "SPDX-License-Identifier: MIT": "mit",
        "MIT License\n\nCopyright (c) 2020 A. Writer\n": "mit", "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0",
        "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991": "gpl,gpl-2.0", "SPDX-License-Identifier: Zlib": "",
        textwrap.fill(next(t for n, t in TEMPLATES if n == "gpl-3.0" and "program" in t), 40): "gpl,gpl-3.0",
        textwrap.fill(next(t for n, t in TEMPLATES if n == "gpl-2.0" and "program" in t), 40): "gpl,gpl-2.0",
        "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa-4.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "gpl,lgpl-3.0",
        "Released under the MIT License. Licensed under the Apache License, v 2.0.": "apache-2.0,mit",
    }
    assert [labels for labels, _ in labels_of(spark, texts)] == list(texts.values())


def test_words_within_a_better_match(spark):
    templates = [("short", "alpha beta gamma delta epsilon"), ("long", "alpha beta gamma delta zeta"),
                 ("other", "one two three four five")]
    text = "alpha beta gamma delta epsilon one two three four"
    docs = spark.createDataFrame([(1, text, None, None, 0, 1, "v", 1, "k", "z")], COLUMNS)
    assert [r.labels for r in license_scan(docs, templates=templates).collect()] == ["other,short"]
