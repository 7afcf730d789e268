from __future__ import annotations

import itertools
import random
import re

import pytest
from conftest import SMALL

from __spark_entry__ import queries
from diamondframe.llm.common import NO_ID
from diamondframe.llm.decontamination import (
    MASKS, SHORT_MASKS, SPAN, SUBSTITUTED, WINDOW, clean_documents, contamination,
)

from llm.brute import COLUMNS, edge_rows, key, prose

SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [w for w in SEPARATOR.split((text or "").lower()) if w]


def overlaps(docs, items):
    """(doc, item) to the best window: most equal words, then first place."""
    out = {}
    for (i, t), (item, u) in itertools.product(docs, items):
        a, b = words(t), words(u)
        size = min(WINDOW, len(b))
        least = size - (2 if size >= 13 else 1 if size >= 8 else 0)
        known = set(a)
        if not b or sum(w in known for w in b) < least:  # no window can have so many
            continue
        for at in range(len(a) - size + 1):
            for to in range(len(b) - size + 1):
                equal = sum(x == y for x, y in zip(a[at : at + size], b[to : to + size]))
                if equal >= least:
                    old = out.get((key(i), item))
                    if old is None or (-equal, at) < (-old[0], old[1]):
                        out[key(i), item] = (equal, at)
    return out


def test_masks_find_every_window_with_so_many_substitutions():
    for gone in itertools.combinations(range(WINDOW), SUBSTITUTED):
        assert any(
            not {at + k for k in mask} & set(gone) for mask in MASKS for at in range(WINDOW - SPAN + 1)
        )


def test_short_masks_find_every_item_with_one_substitution():
    for gone in range(WINDOW):
        assert any(gone not in mask for mask in SHORT_MASKS)
    assert all(max(mask) < SPAN for mask in (*MASKS, *SHORT_MASKS))


@pytest.mark.parametrize("lengths", [[7], [12], [1, 2, 3], [8, 9, 10, 11, 12, 13, 14], [4, 5, 6, 7, 8, 30]])
def test_items_of_every_length(spark, lengths):
    """Whole items, items with one and two words changed, at the ends and inside of texts."""
    made, docs = random.Random(sum(lengths)), []
    items = [(n, prose(900 + n, n)) for n in lengths]
    for k in range(90):
        part = made.choice(items)[1].split()
        for _ in range(k % 3):
            part[made.randrange(len(part))] = "changed"
        sides = [prose(k + 70 * s, made.randrange(0, 12)) for s in (0, 1)]
        docs.append((k, f"{sides[0]}, {' '.join(part)} {sides[1]}"))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = overlaps(docs, items)
    got = {(key(r.doc_id), r.item_id): (r.n_equal, r.first_word) for r in contamination(table, bench).collect()}
    assert got == want and want


def cases(spark):
    made = random.Random(1)
    items = [(n, prose(200 + n, n_words)) for n, n_words in enumerate([30, 13, 12, 8, 7, 20, 9, 5, 3])]
    items += [(None, prose(300, 16)), (19, None), (20, "")]
    docs = [(i, t) for i, t in ((r[0], r[1]) for r in edge_rows()) if i not in (9, 10)]
    for n in range(60):
        item = made.choice([u for _, u in items if u])
        part = item.split()
        for _ in range(made.randrange(4)):
            part[made.randrange(len(part))] = "other"
        cut = made.randrange(0, 4)
        docs.append((500 + n, f"{prose(n, 6)}. {' '.join(part[cut:]).upper()}; {prose(n + 1, 5)}"))
    docs.append((500, docs[-60][1]))  # a repeated row
    rows = [(i, t, None, None, 0, 1, "v", 1, "k", "z") for i, t in docs]
    bench = spark.createDataFrame(items, "item_id long, text string")
    return docs, items, spark.createDataFrame(rows, COLUMNS), bench


def test_against_brute_force(spark):
    docs, items, table, bench = cases(spark)
    want = overlaps(docs, items)
    got = {(key(r.doc_id), r.item_id): (r.n_equal, r.first_word) for r in contamination(table, bench).collect()}
    assert got == want and len(want) > 20
    left = clean_documents(table, bench)
    assert left.columns == table.columns
    found = {i for i, _ in want}
    assert sorted(key(r.doc_id) for r in left.collect()) == sorted(key(i) for i, _ in docs if key(i) not in found)


def test_empty_tables(spark, no_docs, edge_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(edge_docs, bench).collect() == []
    some = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert contamination(no_docs, some).collect() == []
    assert clean_documents(edge_docs, bench).count() == len(edge_rows())


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()
    got = {(r.doc_id, r.item_id) for r in queries()["op6_benchmark_decontamination"](spark, SMALL).collect()}
    flat = {r.doc_id: " " + " ".join(words(r.text)) + " " for r in docs}
    whole = {(i, b.item_id) for i, t in flat.items() for b in items if " " + " ".join(words(b.text)) + " " in t}
    assert whole <= got and whole
    assert all(i >= 0 for i, _ in got) and NO_ID < 0
