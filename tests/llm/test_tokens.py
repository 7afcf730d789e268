from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL

from __spark_entry__ import queries
from diamondframe.llm import packing, word_pieces
from diamondframe.llm.packing import encoded_pieces, packed_documents, place, sequences
from diamondframe.llm.token_counts import token_counts
from diamondframe.llm.word_pieces import WordCache, load, tokenizer_file

from llm.brute import edge_table


def ids_of(text) -> list[int]:
    return load(tokenizer_file()).encode(text or "", add_special_tokens=False).ids


def pieces_of(rows, capacity=4096):
    for i, t in rows:
        ids = [*ids_of(t), 1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            yield i, n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))


def test_words_have_the_ids_of_the_text():
    made = random.Random(7)
    alphabet = ["a", "B", "ß", "É", "ñ", "Σ", "İ", "K", "'", "'s", "'LL", ".", ",", "!", "—", "“", "1", "½", "_", "-",
                "<|endoftext|>", "<|ENDOFTEXT|>", "<|", " ", "  ", "\n", "\t", "\x1c", "\xa0", " ", "é", "中", "😀"]
    cache = WordCache(tokenizer_file(), word_pieces.VALUES["bytes"])
    texts = ["".join(made.choices(alphabet, k=made.randrange(30))) for _ in range(3000)]
    found = [b""] * len(texts)
    for row, ids in cache.values(texts):
        found[row] += b"".join(ids)
    for text, ids in zip(texts, found):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == ids_of(text), repr(text)


def test_letters_below_0250_inside_words():
    cache = WordCache(tokenizer_file(), word_pieces.VALUES["bytes"])
    letters = [c for c in map(chr, range(0xAA, 0x250)) if c.isalpha()]
    texts = [word for c in letters for word in (f"{c}li", f"a{c}yes", f"NO{c} and more, {c}{c}")]
    found = [b""] * len(texts)
    for row, text in enumerate(texts):  # one by one, as a part with one other letter is cut exactly
        for _, ids in cache.values([text]):
            found[row] += b"".join(ids)
    wrong = [t for t, ids in zip(texts, found) if list(struct.unpack(f"<{len(ids) // 4}I", ids)) != ids_of(t)]
    assert not wrong


def test_full_caches_and_long_texts(monkeypatch):
    monkeypatch.setattr(word_pieces, "CACHE_WORDS", 20)
    monkeypatch.setattr(word_pieces, "PART", 64)
    made = random.Random(8)
    cache = WordCache(tokenizer_file(), len, {"the": 1})
    texts = [" ".join("".join(made.choices("abcdeé.", k=made.choice([3, 5, 90]))) for _ in range(40)) for _ in range(60)]
    n = [0] * len(texts)
    for row, lengths in cache.values(texts):
        n[row] += sum(lengths)
    assert n == [len(ids_of(t)) for t in texts]
    assert len(cache.words) <= 20 + 1 + 80


def test_words_are_remembered_once_and_frequent_ones_stay(monkeypatch):
    monkeypatch.setattr(word_pieces, "CACHE_WORDS", 20)
    cache = WordCache(tokenizer_file(), len)
    encoded = []
    encode = cache._encode
    monkeypatch.setattr(cache, "_encode", lambda forms: encoded.extend(forms) or encode(forms))
    letters = "abcdefghijklmnop"
    texts = [" ".join(["water", *[f"w{a}{b}" for b in letters]]) for a in letters]
    for text in texts:
        found = [n for _, lengths in cache.values([text]) for n in lengths]
        assert sum(found) == len(ids_of(text))
    assert encoded.count("water") == 1
    # Small letters are their own form, so no word is held a second time.
    assert not cache.forms and len(cache.words) <= 20 + 17


def test_counts_equal_the_library(spark, edge_docs):
    rows = edge_table()
    want = Counter((i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 2048) for i, t in rows)
    got = token_counts(edge_docs, tokenizer_file())
    assert got.columns == [*edge_docs.columns, "n_bytes", "n_tokens", "over_limit"]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in queries()["op5_token_counts"](spark, SMALL).collect()}
    assert got == {r.doc_id: len(ids_of(r.text)) for r in docs}


def test_clashing_names(edge_docs):
    named = edge_docs.withColumnsRenamed({"id": "N_Tokens", "version": "over_limit"})
    got = token_counts(named, tokenizer_file())
    assert len({c.lower() for c in got.columns}) == len(got.columns)


def test_empty_table(no_docs):
    assert token_counts(no_docs, tokenizer_file()).collect() == []
    assert packed_documents(no_docs, tokenizer_file()).collect() == []


def check_packed(got, want, capacity):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(inside)


@pytest.mark.parametrize("capacity, lane", [(4096, 16_384), (64, 50)])
def test_packing_edges(edge_docs, monkeypatch, capacity, lane):
    monkeypatch.setattr(packing, "LANE_ROWS", lane)
    want = list(pieces_of(edge_table(), capacity))
    got = packed_documents(edge_docs, tokenizer_file(), capacity).collect()
    check_packed(got, want, capacity)


def test_packing_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = list(pieces_of([(r.doc_id, r.text) for r in docs]))
    n = check_packed(queries()["op10_sum_of_squares_packing"](spark, SMALL).collect(), want, 4096)
    assert n <= 1.03 * sum(w[3] for w in want) / 4096 + 2


def test_a_piece_goes_where_the_sum_of_squares_is_least():
    made = np.random.default_rng(4)
    lengths = np.sort(made.integers(1, 64, 400))[::-1]
    sequence, offset = place(lengths, 64)
    gaps: dict[int, int] = {}
    for length, s, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        def total(change):
            count = Counter(g for g in change.values() if g)
            return sum(n * n for n in count.values())

        options = {k: total(gaps | {k: g - length}) for k, g in gaps.items() if g >= length}
        fresh = total(gaps | {-1: 64 - length})
        chosen = total(gaps | {s: gaps.get(s, 64) - length})
        assert chosen == min([fresh, *options.values()])
        assert at == 64 - gaps.get(s, 64)
        gaps[s] = gaps.get(s, 64) - length
    assert sequence.max() + 1 <= 1.08 * lengths.sum() / 64 + 2


def test_the_sequences_themselves(edge_docs):
    found = sequences(edge_docs.filter("doc_id < 9"), tokenizer_file(), 512).collect()
    rows = [(i, t) for i, t in edge_table() if i is not None and i < 9]
    total = sum(len(ids_of(t)) + 1 for _, t in rows)
    assert sum(len(r.ids) for r in found) == 4 * total and all(len(r.ids) <= 4 * 512 for r in found)
    ends = sum(struct.unpack(f"<{len(r.ids) // 4}I", r.ids).count(1) for r in found)
    assert ends >= len(rows)
    with_ids = encoded_pieces(edge_docs, tokenizer_file(), 512).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in with_ids)
