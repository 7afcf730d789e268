from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from conftest import SF

from __spark_entry__ import oracle_sql, queries
from compare import compare, duckdb_over
from diamondframe.llm.line_dedup import drop_repeated_lines

from llm.brute import edge_table, fold, key


def test_equals_its_sql(spark):
    name = "op4_line_dedup"
    found = compare(spark, duckdb_over(SF), queries()[name], oracle_sql()[name], SF)
    assert found["types"] is True and found["equal"], found


@pytest.mark.parametrize("min_docs", [2, 3])
def test_edges(edge_docs, min_docs):
    rows = edge_table()
    holders = defaultdict(set)
    line_key = lambda line: fold(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[line_key(line)].add(key(i))
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [
            x for x in lines
            if len(k := line_key(x)) < 10 or len(holders[k]) < min_docs or min(holders[k]) == key(i)
        ]
        text = "\n".join(kept)
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = drop_repeated_lines(edge_docs, min_docs=min_docs)
    assert got.columns[: len(edge_docs.columns)] == edge_docs.columns
    found = Counter(
        (r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got.collect()
    )
    assert found == want


def test_empty_table(no_docs):
    assert drop_repeated_lines(no_docs).collect() == []
