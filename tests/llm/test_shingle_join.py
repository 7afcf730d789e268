from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL

import corpus_pipeline
from __spark_entry__ import queries
from diamondframe.llm.common import NO_ID
from diamondframe.llm.components import components
from diamondframe.llm.count_tree import CountTree, links
from diamondframe.llm.shingle_join import (
    _described, _keyed, _keys, _members, jaccard_components, one_text_of_each_group,
)
from diamondframe.llm.shingles import shared_keys

from llm.brute import COLUMNS, edge_rows, edge_table, fold, key, prose


def shingles(text, width):
    words = fold(text).encode().split()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def joined(rows, width, percent):
    """Component and number of links of each (doc, text)."""
    texts = sorted({(key(i), t or "") for i, t in rows})
    sets = {x: shingles(x[1], width) for x in texts}
    root = {i: i for i, _ in texts}
    count = Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(texts):
        for b in texts[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                if a[0] != b[0]:
                    count[a] += 1
                    count[b] += 1
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    return {x: (len(sets[x]), find(x[0]), count[x]) for x in texts}


def test_all_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {i: v for (i, _), v in joined([(r.doc_id, r.text) for r in docs], 3, 90).items()}
    got = queries()["op2_shingle_join"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == want
    assert sum(r.n_links for r in got) > 10


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_edges(edge_docs, width, percent):
    rows = edge_table()
    want = joined(rows, width, percent)
    expected = Counter((key(i), *want[key(i), t or ""][:2]) for i, t in rows)
    got = jaccard_components(edge_docs, width, percent).collect()
    assert Counter((r.doc, r.n, r.component) for r in got) == expected


def test_empty_table(no_docs):
    assert jaccard_components(no_docs, 3, 90).collect() == []


def test_no_texts(no_docs, edge_docs):
    assert one_text_of_each_group(no_docs).collect() == []
    empty = edge_docs.filter("doc_id = 5")
    assert one_text_of_each_group(empty).collect() == empty.collect()


def texts_left(rows, width=5, percent=80):
    """The (doc, text) that stay, with texts as nodes; a group's first one may be any of a doc's."""
    texts = sorted({t for _, t in rows if shingles(t, width)})
    groups = defaultdict(set)
    for n, (_, component, _) in joined(list(enumerate(texts)), width, percent).items():
        groups[component].add(n[1])
    return [(min(key(i) for i, t in rows if t in group), group) for group in groups.values()]


def test_texts_without_or_under_one_doc_id(spark):
    a, b, c, d, e = (prose(500 + k, 80) for k in range(5))
    near = lambda t: t + " the end"
    texts = [(None, a), (None, b), (None, c), (5, near(a)), (9, near(b)), (7, d), (7, e), (8, near(d)), (7, d)]
    texts += [(None, ""), (None, None), (3, " \n"), (3, " \n"), (10, near(e)), (11, e.upper())]
    rows = [(i, t, None, None, None, 0, "", 0, "", "") for i, t in texts] + edge_rows()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    left = [(key(r.doc_id), r.text) for r in got.collect()]
    want = texts_left([(r[0], r[1]) for r in rows])
    with_words = [x for x in left if shingles(x[1], 5)]
    assert len(with_words) == len(want) and {t for _, t in with_words} >= {a, b, c}
    for i, group in want:
        assert [j for j, t in with_words if t in group] == [i]
    assert Counter(x for x in left if not shingles(x[1], 5)) == Counter(
        (key(r[0]), r[1]) for r in rows if not shingles(r[1], 5)
    )


def test_a_large_family_over_several_leaves(spark, monkeypatch):
    """Texts at all distances from each other; leaves of 16 sets, so many pairs of leaves."""
    monkeypatch.setattr("diamondframe.llm.shingle_join.LEAF_SETS", 16)
    made = random.Random(3)
    base = [f"w{made.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(made.randrange(9)):
            words[made.randrange(150)] = f"x{i}-{made.randrange(99)}"
        rows.append((i, " ".join(words), None, None, None, 0, "", 0, "", ""))
    got = jaccard_components(spark.createDataFrame(rows, COLUMNS), 3, 90).collect()
    want = joined([(r[0], r[1]) for r in rows], 3, 90)
    assert {r.doc: (r.n, r.component, r.n_links) for r in got} == {i: v for (i, _), v in want.items()}


@pytest.mark.parametrize("texts, common, own", [(60, 75, 30), (12, 6000, 4000)])
def test_texts_with_a_passage_in_common_are_no_cluster(spark, texts, common, own):
    """They share keys and none link; as one cluster each would go to meetings with all others."""
    made = random.Random(common)
    passage = [f"w{made.randrange(10**6)}" for _ in range(common)]
    rows = [(i, " ".join(passage + [f"x{i}-{k}" for k in range(own)])) for i in range(texts)]
    near = rows[0][1].replace("x0-7 ", "else ")
    keyed = _keyed(spark.createDataFrame([*rows, (texts, near)], "doc_id long, text string"))
    members = _members(_described(keyed, 5), _keys(keyed, 5, 80), 80).collect()
    assert {r.doc for r in members} == {0, texts}


@pytest.mark.parametrize("most", [3, 40])
def test_a_key_of_more_texts_than_are_compared(spark, monkeypatch, most):
    monkeypatch.setattr("diamondframe.llm.shingle_join.KEY_TEXTS", most)
    rows = [(k, prose(900 + k % 3, 60) + f" end {k}" * (k % 4)) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = joined(rows, 3, 90)
    got = jaccard_components(docs, 3, 90).collect()
    assert {r.doc: (r.n, r.component, r.n_links) for r in got} == {i: v for (i, _), v in want.items()}


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key(percent):
    made = np.random.default_rng(percent)
    for size in [1, 2, 3, 5, 9, 10, 11, 19, 40, 95, 300, 1000]:
        for _ in range(40):
            base = made.integers(0, 2**63, size, dtype=np.uint64)
            # As many changes as a link allows.
            common = -(-percent * size // 100)
            smaller = np.unique(base[:common])
            swap = (100 - percent) * size // (100 + percent)
            other = np.concatenate([base[swap:], made.integers(0, 2**63, swap, dtype=np.uint64)])
            for near in (smaller, np.unique(other)):
                a = np.unique(base)
                both = len(np.intersect1d(a, near))
                if 100 * both >= percent * (len(a) + len(near) - both):
                    assert set(shared_keys(a, percent)) & set(shared_keys(near, percent))


def test_trees_find_every_link():
    made = np.random.default_rng(1)
    pool = made.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(made.choice(pool[:n], int(n * f))) for n in (40, 80, 400) for f in (0.5, 2, 3, 4) for _ in range(20)]
    for percent in (80, 90):
        want = set()
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    want.add((j, i))
        tree = CountTree(sets)
        assert {tuple(sorted(p)) for p in links(tree, tree, percent)} == want and want
        half = len(sets) // 2
        left, right = CountTree(sets[:half]), CountTree(sets[half:])
        across = {(i, j + half) for i, j in links(left, right, percent)}
        assert across == {(i, j) for i, j in want if i < half <= j}


def test_components(spark):
    made = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    edges += [(1000 + made.randrange(300), 1000 + made.randrange(300)) for _ in range(150)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {i for i in root if sum(i in e and e[0] != e[1] for e in edges) == 0}
    assert got == {i: find(i) for i in root if i not in alone}
    assert NO_ID < 0
