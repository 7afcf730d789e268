from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from __spark_entry__ import queries
from diamondframe.llm.byte_windows import runs, segments
from diamondframe.llm.suffix_dedup import _cores, remove_repeats

from llm.brute import edge_table, key


def removed(rows: list[tuple], window: int = 100) -> dict:
    """Removed stretches of each (doc_id, text), by a set of all earlier strings."""
    distinct = sorted({(key(i), t or "") for i, t in rows})
    first: dict[bytes, tuple] = {}
    for i, t in distinct:
        data = t.encode()
        for at in range(len(data) - window + 1):
            piece = data[at : at + window]
            first[piece] = min(first.get(piece, (i, at)), (i, at))
    out = {}
    for i, t in distinct:
        data = t.encode()
        gone = bytearray(len(data))
        for at in range(len(data) - window + 1):
            if first[data[at : at + window]] < (i, at):
                gone[at : at + window] = b"\1" * window
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, t] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_all_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = removed([(r.doc_id, r.text) for r in docs])
    got = queries()["op1_suffix_dedup"](spark, SMALL).collect()
    assert len(got) == len(docs)
    by_id = {i: v for (i, _), v in want.items()}
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == by_id[r.doc_id]
    assert sum(r.n_removed for r in got) > 10_000


def test_edges(edge_docs):
    rows = edge_table()
    want = removed(rows)
    expected = Counter((i, *want[key(i), t or ""]) for i, t in rows)
    got = remove_repeats(edge_docs).collect()
    assert Counter(
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got
    ) == expected
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


@pytest.mark.parametrize("ids", [(5, 6), (5, 5), (None, None), (None, 5)])
def test_texts_whose_hashes_end_alike_stay_apart(spark, ids):
    """One text repeats itself, the other nowhere; their hashes agree in the low 16 bits."""
    made = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz "
    half = "".join(made.choices(letters, k=300))
    one = half + "--------" + half
    body = "".join(made.choices(letters, k=688))
    tail = F.lpad(F.col("id").cast("string"), 12, "q")
    hashed = spark.range(1_000_000).select(tail.alias("tail"), F.xxhash64(F.concat(F.lit(body), tail)).alias("h"))
    low = spark.range(1).select(F.xxhash64(F.lit(one)).bitwiseAND(0xFFFF)).first()[0]
    other = body + hashed.filter(F.col("h").bitwiseAND(0xFFFF) == low).first().tail
    rows = [(ids[0], one), (ids[1], other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed(rows)
    got = {(r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(docs).collect()}
    assert got == {v[:3] for v in want.values()} == {(608, 300, 1), (700, 0, 0)}


def test_empty_table(no_docs):
    assert remove_repeats(no_docs).collect() == []


def test_equal_windows_share_an_anchor():
    made = random.Random(5)
    passage = bytes(made.choices(b"abcdef ", k=160))
    found = {}
    for _ in range(3):
        text = bytes(made.choices(b"abcdef ", k=90)) + passage + bytes(made.choices(b"abcdef ", k=70))
        data = np.frombuffer(text, dtype=np.uint8)
        gram, _, anchor, first, last = runs(data, 100)
        assert first[0] == 0 and last[-1] == len(text) - 100 and (first[1:] == last[:-1] + 1).all()
        for g, a, f, l in zip(gram, anchor, first, last):
            for at in range(f, l + 1):
                piece = text[at : at + 100]
                assert found.setdefault(piece, (int(g), int(a) - at)) == (int(g), int(a) - at)


def test_segments_hold_each_window_once(monkeypatch):
    monkeypatch.setattr("diamondframe.llm.byte_windows.SEGMENT", 50)
    text = bytes(range(256)) * 2
    starts = [at + k for at, data in segments(text, 100) for k in range(len(data) - 99)]
    assert starts == list(range(len(text) - 99))
    assert list(segments(b"x" * 99, 100)) == []


def test_a_core_and_its_sides_make_the_window():
    """Blocks of equal windows have equal cores, and equal bytes on both sides of them."""
    made = random.Random(6)
    passage = bytes(made.choices(b"abcdef ", k=220))
    seen = {}
    for n in range(4):
        text = bytes(made.choices(b"abcdef ", k=50 + n)) + passage + bytes(made.choices(b"abcdef ", k=40))
        data = np.frombuffer(text, dtype=np.uint8)
        _, _, anchor, first, last = runs(data, 100)
        core, left, right, found, most, least = _cores(data, anchor, anchor - first, anchor - last, 100)
        starts = sorted(a - o for a, m, k in zip(found, most, least) for o in range(k, m + 1))
        assert starts == list(range(len(text) - 99))
        for c, a, m, k in zip(core, found, most, least):
            for o in range(k, m + 1):
                piece = text[a - o : a - o + 100]
                assert seen.setdefault(piece, int(c)) == int(c)
        assert left.min() > -(2**63) and len(left) == len(right)
