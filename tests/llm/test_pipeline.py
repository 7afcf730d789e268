"""The whole pipeline against plain rules, and its stages on the edge cases."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from conftest import SMALL

import corpus_pipeline
from diamondframe.session import shared_path

from llm.brute import COLUMNS, fold
from llm.test_decontamination import overlaps
from llm.test_quality_rules import judged, table
from llm.test_shingle_join import joined
from llm.test_tokens import check_packed, pieces_of


def without_lines(rows):
    """(doc_id, text) without lines that a smaller doc_id has."""
    line_key = lambda line: fold(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[line_key(line)].add(i)
    for i, t in rows:
        yield i, "\n".join(
            x for x in (t or "").split("\n")
            if len(k := line_key(x)) < 10 or len(holders[k]) < 2 or min(holders[k]) == i
        )


def expected(docs, items):
    """doc_id and text of what the first four stages leave, of (doc_id, text, lang, source)."""
    verdict = judged([(t, lang, source) for _, t, lang, source in docs])
    rows = [(i, t) for (i, t, _, _), (kept, _) in zip(docs, verdict) if kept]
    rows = list(without_lines(rows))
    groups = joined(rows, 5, 80)
    rows = [(i, t) for (i, t), (_, component, _) in groups.items() if i == component]
    bad = {i for i, _ in overlaps(rows, items)}
    return [(i, t) for i, t in rows if i not in bad]


def test_run_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = expected(docs, items)
    assert 0 < len(left) < len(docs)
    check_packed(corpus_pipeline.run(spark, SMALL).collect(), list(pieces_of(left)), 4096)


@pytest.fixture(scope="module")
def folder(spark):
    """Edge cases and made rows as a data folder."""
    path = shared_path(spark, "pipeline-test")
    rows = table()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    items = [(1, rows[40][1]), (2, None), (None, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        path = shared_path(spark, name)
        after.write.parquet(path)
        before = spark.read.parquet(path)
        assert 0 < before.count() <= docs.count()
    for r in before.collect():
        assert r.id == 7 and r.version == "v" and r.n_chars == len(r.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in before.collect())


def test_empty_tables(spark, no_docs):
    path = shared_path(spark, "pipeline-empty")
    no_docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_duplicates", "benchmark_decontamination", "packing"
    ]
