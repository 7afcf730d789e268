from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from __spark_entry__ import queries
from diamondframe.llm import winnowing as W
from diamondframe.llm.common import id_key, text_value

from llm.brute import COLUMNS, edge_table, prose

MASK = 2**64 - 1


def mixed(x: int) -> int:
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & MASK
    x ^= x >> 32
    x = x * 0xCF1BBCDCB7A56463 & MASK
    return x ^ x >> 29


def plain(text: str, gram: int = W.GRAM, window: int = W.WINDOW) -> list[tuple[int, int]]:
    """Position and hash of every choice, window by window."""
    if not text:
        return []
    gram = min(gram, len(text))
    hashes = []
    for at in range(len(text) - gram + 1):
        whole = 0
        for c in text[at : at + gram]:
            whole = (whole * 0x9E3779B97F4A7C15 + mixed(ord(c) + 1)) & MASK
        hashes.append(mixed(whole))
    window = min(window, len(hashes))
    chosen = set()
    for at in range(len(hashes) - window + 1):
        part = hashes[at : at + window]
        chosen.add((max(k for k in range(window) if part[k] == min(part)) + at, min(part)))
    return sorted(chosen)


def written_out(choices: list[tuple[int, int]]) -> str:
    before, out = 0, []
    for position, value in choices:
        out.append(f"{value:016x}{position - before:02x}")
        before = position
    return "".join(out)


def alike(one: list, other: list) -> float:
    a, b = {h for _, h in one}, {h for _, h in other}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs: list[tuple]) -> dict:
    """Results of each distinct (id, version, text), in their order."""
    out = {}
    order = sorted(set(docs))
    for k, (i, v, text) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        last = len(text) // 4
        edited = text[: len(text) - last] + following[:last]
        own, new = plain(text), plain(edited)
        out[i, v] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), written_out(own), written_out(new),
                     alike(own, new), alike(own, plain(following)))
    return out


def rows_of(docs) -> list[tuple]:
    keyed = docs.select(id_key().alias("i"), F.xxhash64(text_value()).alias("v"), text_value().alias("t"))
    return [tuple(r) for r in keyed.collect()]


def checked(docs, found=None) -> None:
    rows = rows_of(docs)
    want = expected(rows)
    expect = Counter((None if i == -(2**63) else i, *want[i, v]) for i, v, _ in rows)
    got = Counter(tuple(r) for r in (found or W.edit_likeness(docs)).collect())
    assert got == expect


@pytest.fixture(scope="module")
def small(spark):
    """Documents of the smallest folder, but for the longest: the plain rule is slow."""
    return spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.length("text") < 3000)


def test_documents_against_plain_windows(spark, small):
    checked(small)


def test_whole_query(spark):
    got = queries()["op11_winnowing"](spark, SMALL).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = sorted(docs)
    assert sorted(r.doc_id for r in got) == ids
    prints = {}
    for r in got:
        following = docs[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        text, last = docs[r.doc_id], len(docs[r.doc_id]) // 4
        edited = text[: len(text) - last] + following[:last]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    long_ones = [r for r in got if r.n_chars > 400 and docs[ids[(ids.index(r.doc_id) + 1) % len(ids)]] != docs[r.doc_id]]
    # A text that mostly repeats itself may have what is its own in the last quarter.
    assert sorted(r.near_edited for r in long_ones)[len(long_ones) // 10] > 0.4
    assert sorted(r.near_next for r in long_ones)[len(long_ones) * 9 // 10] < 0.3


def test_edges(spark):
    # The very long texts of the edge table are held against themselves in segments below.
    rows = [(i, t) for i, t in edge_table() if len(t or "") < 3000] + [(20, "x" * 60), (21, "x" * 60), (22, "é" * 15 + "💡" * 30)]
    table = [(i, t, "en", "s", 1, 7, "v", 1, "k", "z") for i, t in rows]
    for partitions in (1, 5):
        checked(spark.createDataFrame(table, COLUMNS).repartition(partitions))


def test_one_document_and_repeated_rows(spark):
    def docs(*rows):
        return spark.createDataFrame([(i, t, "en", "s", 1, 7, "v", 1, "k", "z") for i, t in rows], COLUMNS)

    checked(docs((1, prose(1, 40))))
    checked(docs(*[(None, prose(1, 30))] * 50, (2, prose(2, 30)), *[(2, prose(2, 30))] * 3, (2, "other " + prose(3, 9))))
    got = W.edit_likeness(docs((1, None), (2, ""))).collect()
    assert [(r.n_chars, r.fingerprint, r.near_edited, r.near_next) for r in got] == [(0, "", 1.0, 1.0)] * 2


def test_empty_table(no_docs):
    assert W.edit_likeness(no_docs).collect() == [] and W.fingerprints(no_docs).collect() == []


@pytest.mark.parametrize("gram, window", [(1, 1), (1, 7), (3, 4), (5, 1), (16, 33), (13, 50)])
def test_choices_for_any_sizes(gram, window):
    made = random.Random(gram * 100 + window)
    for letters in ("ab", "abcdefgh ", "aäé☃💡"):
        for n in (1, 2, gram, gram + window - 1, gram + window, 90):
            text = "".join(made.choices(letters, k=n))
            hashes, positions = W.winnow(W.code_points(text), gram, window)
            assert list(zip(positions.tolist(), hashes.tolist())) == plain(text, gram, window)


def test_segments_change_nothing(monkeypatch):
    text = W.code_points(prose(9, 3000))
    whole = W.winnow(text)
    monkeypatch.setattr(W, "SEGMENT", 70)
    parts = W.winnow(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_a_shared_passage_shares_a_gram_at_its_place():
    made = random.Random(4)
    passage = "".join(made.choices("abcdefghijklmnop ", k=W.GRAM + W.WINDOW - 1))
    for n in range(20):
        places = []
        for _ in range(2):
            left, right = (made.choices("qrstuvwxyz ", k=made.randrange(90)) for _ in range(2))
            hashes, positions = W.winnow(W.code_points("".join(left) + passage + "".join(right)))
            places.append({(int(h), int(p) - len(left)) for h, p in zip(hashes, positions)})
        shared = {(h, p) for h, p in places[0] & places[1] if 0 <= p <= len(passage) - W.GRAM}
        assert shared


def test_text_form_and_general_fingerprints(spark, small):
    rows = {r.doc_id: r for r in W.fingerprints(small).collect()}
    for r in W.edit_likeness(small).collect():
        hashes, positions = W.from_text(r.fingerprint)
        assert hashes.view(np.int64).tolist() == rows[r.doc_id].hashes
        assert positions.tolist() == rows[r.doc_id].positions
    with pytest.raises(ValueError):
        W.fingerprints(small, 16, 300)
