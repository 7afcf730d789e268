"""Suffix-array dedup by a depth-limited radix sort.

The suffixes of all texts are put in order only as far as ``window`` bytes, digit by digit, and
only where it matters: a suffix whose digits so far nobody shares leaves the sort. What is left
in equal groups at the end are exactly the repeated windows.

* The first digit of a suffix is the hash of its anchor (``byte_windows``), not of its first
  bytes: equal windows have equal ones, and about thirty neighbours share one, so a run of
  suffixes moves as one row and a corpus costs about one row for thirty bytes. A second key, the
  hash of all bytes of the run, settles runs that are equal as a whole.
* The second digit is for the runs that share the first one without being equal. It is the
  hash of the bytes that up to eight neighbouring windows have in common, their core. Its second
  key are the few bytes to the left and right of the core that the windows reach.
* The last digit is the window's own: its core with its bytes to the left and right. It follows
  from the row before, so the texts are not read for it.

A task sorts its own rows first and hands on the first of each group; the rest are repeats for
certain. Groups are read as a sorted stream, one row of memory each, so a passage in a third
of all documents needs no room. Hashes have 64 bits; second keys add 64 more, or 16 beside the
bytes themselves. Texts cross the shuffle compressed, by doc_id and hash of the text, which
every row carries, so texts that share a doc_id or have none never take each other's places.

Documents are ordered by doc_id. Defined results: a missing or empty text has no bytes; a text
shorter than the window keeps all; rows with equal doc_id and text are one document and get
equal results; of different texts with one doc_id, a string is earlier where it starts earlier
in its text, and then by the hash of the text; rows without doc_id are one document that comes
first; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from diamondframe.llm.byte_windows import GRAM, Hashes, mix, runs, segments
from diamondframe.llm.common import id_key, id_value, read_table, release_memory, text_value
from diamondframe.session import written

WINDOW = 100
#: Rows that a task sorts at once, and hands on at once.
SORTED_ROWS, ROWS_OUT = 1 << 19, 1 << 16
PACKED_LEVEL = 5

#: Windows that share a core, and the bytes beside it that they reach.
BLOCK, BESIDE = 8, 7

_RUN_KEYS, _CORE_KEYS = ["k1", "k2"], ["k1", "left", "right"]
#: What follows the keys: the document, the place in its text, the hash of the text.
_OWNER = ["doc", "place", "version"]


def _schema(keys: list[str]) -> str:
    return ", ".join(f"{name} long" for name in [*keys, *_OWNER])


def _place(start: np.ndarray, before: np.ndarray | int, after: np.ndarray | int) -> np.ndarray:
    """Anchor, and how far first and last start are before the anchor."""
    return start.astype(np.int64) << 16 | before << 8 | after


def _owners(doc: int, version: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, doc, np.int64), np.full(n, version, np.int64)


def _firsts(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows in order; of those with equal keys, all but the first get a negative place.

    A row that says the same as the first, from a repeated row of the table, counts as the first.
    """
    order = np.lexsort(columns[::-1])
    *keys, doc, place, version = (c[order] for c in columns)
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    repeat = (doc != doc[head]) | (place != place[head]) | (version != version[head])
    # Settled rows go on under a digit of their own, so that they are dealt evenly.
    keys[0] = np.where(repeat, place * 0x5851F42D4C957F2D ^ doc ^ version, keys[0])
    return [*keys, doc, np.where(repeat, -1 - place, place), version]


class _Sorter:
    """Collects rows of a task and hands them on block by block."""

    def __init__(self, keys: list[str]):
        self.names = [*keys, *_OWNER]
        self.held: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append([np.asarray(c).view(np.int64) for c in columns])
        self.size += len(columns[0])
        if self.size >= SORTED_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = _firsts([np.concatenate(c) for c in zip(*self.held)])
            self.held, self.size = [], 0
            for at in range(0, len(columns[0]), ROWS_OUT):
                part = [pa.array(c[at : at + ROWS_OUT], pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays(part, self.names)


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, version, text): the text compressed, for the shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=PACKED_LEVEL)
        for batch in batches:
            texts = [compressor.compress(t.as_py()) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.binary())], ["doc", "version", "text"]
            )
        release_memory()

    return docs.mapInArrow(pack, "doc long, version long, text binary")


def _first_digits(docs: DataFrame, window: int) -> DataFrame:
    """A row per run: first digit, second digit, document, place."""

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter = _Sorter(_RUN_KEYS)
        for batch in batches:
            keys, versions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, version, text in zip(keys, versions, batch.column(2).cast(pa.binary())):
                for at, data in segments(text.as_py(), window):
                    gram, whole, anchor, first, last = runs(data, window)
                    owner, text_hash = _owners(doc, version, len(gram))
                    place = _place(anchor + at, anchor - first, anchor - last)
                    yield from sorter.add(gram, whole, owner, place, text_hash)
        yield from sorter.flush()
        release_memory()

    return docs.mapInArrow(digits, _schema(_RUN_KEYS))


def _groups(rows: DataFrame, keys: list[str], undecided: bool) -> DataFrame:
    """Reads the groups of the first key, in order: rows that are settled or go on.

    A negative place is a repeat. A place from 0 on (only if ``undecided``) is the first row of
    its further keys, in a group of the first key that has others too.
    """
    names, n_keys = [*keys, *_OWNER], len(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last group's rows that may still matter: its first one, and the first of its last
        # further keys; whether a row has been handed on.
        held = np.empty((len(names), 0), dtype=np.int64)
        held_done = np.empty(0, dtype=bool)
        for batch in batches:
            new = np.stack([batch.column(i).to_numpy() for i in range(len(names))])
            settled = new[:, new[-2] < 0]
            new = new[:, new[-2] >= 0]
            rows = np.concatenate([held, new], axis=1)
            done = np.concatenate([held_done, np.zeros(new.shape[1], dtype=bool)])
            out = [settled]
            if rows.shape[1]:
                doc, place, version = rows[-3:]
                index = np.arange(len(doc))
                changed = rows[:n_keys, 1:] != rows[:n_keys, :-1]
                first = np.concatenate([[True], changed[0]])
                first_of_all = np.concatenate([[True], changed.any(axis=0)])
                head = np.maximum.accumulate(np.where(first_of_all, index, 0))
                repeat = ((doc != doc[head]) | (place != place[head]) | (version != version[head])) & ~done
                group = np.cumsum(first) - 1
                several = np.bincount(group, weights=first_of_all)[group] > 1
                # A row equal to its head is a repeated row of the table; the head speaks for it.
                more = first_of_all & several & ~done
                repeats = rows[:, repeat]
                repeats[-2] = -1 - repeats[-2]
                out += [repeats, rows[:, more]] if undecided else [repeats]
                keep = np.unique([index[group == group[-1]][0], head[-1]])
                held, held_done = rows[:, keep], (done | more)[keep]
            found = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)
        release_memory()

    dealt = rows.repartition("k1").sortWithinPartitions(*names)
    return dealt.mapInArrow(read, _schema(keys))


def _beside(data: np.ndarray, core: np.ndarray, reach: np.ndarray, step: int) -> np.ndarray:
    """Up to seven bytes from a place on, leftwards or rightwards, as a number; 0 beyond reach."""
    out = np.zeros(len(core), dtype=np.int64)
    for k in range(BESIDE):
        some = np.flatnonzero(reach > k)
        out[some] |= data[core[some] + step * k].astype(np.int64) << 8 * k
    return out


def _cores(data: np.ndarray, anchor, before, after, window: int) -> tuple[np.ndarray, ...]:
    """A row per block of eight windows of the runs: core hash, bytes beside, anchor, extent.

    The blocks are counted from the anchor, so equal windows are in equal blocks.
    """
    low = after // BLOCK
    n = before // BLOCK - low + 1
    block = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    anchor, before, after = (np.repeat(x, n) for x in (anchor, before, after))
    most, least = np.minimum(before, block * BLOCK + BESIDE), np.maximum(after, block * BLOCK)
    start, length = anchor - block * BLOCK, window - BESIDE
    hashes = Hashes(data)
    core = mix(hashes.some(start, start + length, 0) ^ mix(block.astype(np.uint64)))
    more = hashes.some(start, start + length, 1).view(np.int64)
    left_reach, right_reach = most - block * BLOCK, BESIDE - (least - block * BLOCK)
    left = _beside(data, start - 1, left_reach, -1) | (more & 0x1F) << 59 | left_reach << 56
    right = _beside(data, start + length, right_reach, 1) | (more >> 5 & 0x1F) << 59 | right_reach << 56
    return core, left, right, anchor, most, least


def _second_digits(docs: DataFrame, open_runs: DataFrame, window: int) -> DataFrame:
    """A row per block of the runs that go on: core, bytes beside it, document, place."""
    of_doc = open_runs.groupBy("doc", "version").agg(F.collect_set("place").alias("places"))
    joined = _packed(docs).join(of_doc, ["doc", "version"]).select("doc", "version", "text", "places")

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter, unpack = _Sorter(_CORE_KEYS), zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, version, packed, places in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            ):
                place = places.values.to_numpy()
                anchor, before, after = place >> 16, place >> 8 & 0xFF, place & 0xFF
                text = unpack.decompress(packed.as_py())
                for at, data in segments(text, window):
                    inside = (anchor - before >= at) & (anchor - before <= at + len(data) - window)
                    if inside.any():
                        core, left, right, found, most, least = _cores(
                            data, anchor[inside] - at, before[inside], after[inside], window
                        )
                        owner, text_hash = _owners(doc, version, len(core))
                        yield from sorter.add(core, left, right, owner, _place(found + at, most, least), text_hash)
        yield from sorter.flush()
        release_memory()

    return joined.mapInArrow(digits, _schema(_CORE_KEYS))


def _last_digits(open_blocks: DataFrame) -> DataFrame:
    """A row per window of the blocks that go on: two hashes, document and place of the start."""

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter = _Sorter(_RUN_KEYS)
        for batch in batches:
            core, left, right, doc, place, version = (batch.column(i).to_numpy() for i in range(6))
            anchor, before, after = place >> 16, place >> 8 & 0xFF, place & 0xFF
            more = (left >> 59 & 0x1F | (right >> 59 & 0x1F) << 5).astype(np.uint64)
            for k in range(BLOCK):
                offset = before // BLOCK * BLOCK + k
                some = np.flatnonzero((offset >= after) & (offset <= before))
                if not len(some):
                    continue
                own_left = (left[some] & (1 << 8 * k) - 1).astype(np.uint64)
                own_right = (right[some] & (1 << 8 * (BESIDE - k)) - 1).astype(np.uint64)
                one = core[some].view(np.uint64) ^ mix(own_left | np.uint64(k << 56))
                two = mix(own_right | np.uint64(k << 56)) + mix(own_left ^ more[some] << np.uint64(58))
                start = anchor[some] - offset[some]
                yield from sorter.add(
                    mix(one ^ mix(own_right)), mix(two ^ core[some].view(np.uint64)), doc[some],
                    _place(start, 0, 0), version[some],
                )
        yield from sorter.flush()
        release_memory()

    return open_blocks.select(*_CORE_KEYS, *_OWNER).mapInArrow(digits, _schema(_RUN_KEYS))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, place, version) of runs of windows that start earlier too; written, see ``_place``."""
    if window <= max(GRAM, BESIDE):
        raise ValueError(f"a window has more than {max(GRAM, BESIDE)} bytes")
    first = written(_groups(_first_digits(docs, window), _RUN_KEYS, True).select(*_OWNER), "first-digits")
    cores = _second_digits(docs, first.filter("place >= 0"), window)
    second = written(_groups(cores, _CORE_KEYS, True), "second-digits")
    last = _groups(_last_digits(second.filter("place >= 0")), _RUN_KEYS, False)
    settled = first.unionByName(second.select(*_OWNER)).filter("place < 0")
    found = settled.unionByName(last.select(*_OWNER))
    return written(found.select("doc", (-1 - F.col("place")).alias("place"), "version"), "repeated-windows")


def _covered(place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches that the windows cover."""
    anchor = place >> 16
    first, last = anchor - (place >> 8 & 0xFF), anchor - (place & 0xFF)
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order] + window)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], np.concatenate([end[:-1][new[1:]], end[-1:]])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and kept of every row.

    ``spans`` are the removed stretches (start, end) in bytes, ``kept`` the remaining bytes, which
    may cut a character in two. A byte goes if a string of ``window`` bytes that covers it starts
    earlier too, in a document with a smaller doc_id or earlier in the same one.
    """
    keyed = docs.select(
        id_key().alias("doc"), F.xxhash64(text_value()).alias("version"), text_value().alias("text")
    )
    found = repeated_windows(keyed, window)
    of_doc = found.groupBy("doc", "version").agg(F.collect_set("place").alias("places"))
    joined = _packed(keyed).join(of_doc, ["doc", "version"], "left").select("doc", "text", "places")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, packed, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text, spans = unpack.decompress(packed.as_py()), []
                if places.is_valid:
                    spans = list(zip(*(c.tolist() for c in _covered(places.values.to_numpy(), window))))
                edges = [0, *(e for span in spans for e in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((doc, len(text), len(text) - len(kept), len(spans),
                             [{"start": a, "end": b} for a, b in spans], kept))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        release_memory()

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    types = [pa.int64()] * 4 + [pa.list_(span), pa.binary()]
    names = ["doc", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    done = joined.mapInArrow(
        remove, "doc long, n_bytes long, n_removed long, n_spans long, "
                "spans array<struct<start: long, end: long>>, kept binary"
    )
    return done.select(id_value("doc").alias("doc_id"), *names[1:])


def op1_suffix_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
