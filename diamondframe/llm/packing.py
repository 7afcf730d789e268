"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Documents are encoded where they lie; only a narrow row per piece moves. Pieces that fill a
sequence are placed alone. The others are dealt over lanes of about ``LANE_ROWS`` pieces, by
a hash of their place in the written table. A lane takes its pieces from long to short. A
piece goes into the residual gap, or into a new sequence, for which the sum of the squared
numbers of open sequences per residual gap becomes smallest; between equals, into the
smallest gap, and into a new sequence last. A lane leaves a few sequences open, whatever
its size; at this lane size they are a few in a thousand.

Defined results: a missing or empty text is one piece that holds the end id alone; rows are
packed one by one, so repeated rows and missing doc_ids need no rule; an empty table gives an
empty table; only doc_id and text are read.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from diamondframe.llm.common import read_table, release_memory, text_value
from diamondframe.llm.word_pieces import WordCache, tokenizer_file, worker_cache
from diamondframe.session import written

CAPACITY, END_ID = 4096, 1
LANE_ROWS = 16_384
#: Rows that a task hands on at once.
ROWS_OUT = 4096


def _cut(texts, cache: WordCache, capacity: int, end_id: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, piece, ids as bytes) of a batch of texts; of a long text, about a piece is held."""
    full, end = 4 * capacity, struct.pack("<I", end_id)
    row, piece, held = 0, 0, b""

    def rest(row: int, piece: int, held: bytes) -> Iterator[tuple[int, int, bytes]]:
        held += end
        for n, at in enumerate(range(0, len(held), full)):
            yield row, piece + n, held[at : at + full]

    for of_row, ids in cache.values(t.as_py() for t in texts):
        while row < of_row:
            yield from rest(row, piece, held)
            row, piece, held = row + 1, 0, b""
        held += b"".join(ids)
        at = 0
        while len(held) - at > full:
            yield row, piece, held[at : at + full]
            piece, at = piece + 1, at + full
        held = held[at:]
    while row < len(texts):
        yield from rest(row, piece, held)
        row, piece, held = row + 1, 0, b""


def encoded_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = True, remembered: int | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every piece of every document.

    A document's ids are those of the tokenizer and then ``end_id``; only documents longer than
    ``capacity`` are cut. ``ids`` is binary, little-endian, four bytes an id; leave it out where
    the placement alone is wanted. A worker remembers ``remembered`` words; fewer take less
    memory and more time.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(tokenizer, "bytes", limit=remembered)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for row, piece, ids in _cut(batch.column(1), cache, capacity, end_id):
                rows.append((keys[row], piece, piece * capacity, len(ids) // 4, zlib.crc32(ids),
                             *([ids] if with_ids else [])))
                if len(rows) >= ROWS_OUT // (16 if with_ids else 1):
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)
        release_memory()

    types = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
             ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    types = types if with_ids else types[:-1]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], [n for n, _ in types]
        )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_value().alias("text")).mapInArrow(
        encode, schema + (", ids binary" if with_ids else "")
    )


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of a lane, the pieces given from long to short."""
    open_bins = np.zeros(capacity + 1, dtype=np.int64)  # by residual gap
    bins: list[deque] = [deque() for _ in range(capacity + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        gap, least = -1, 2 * open_bins[capacity - length] + 1 if length < capacity else 0
        gaps = np.flatnonzero(open_bins[length:]) + length
        if len(gaps):
            # The change of the sum when a sequence leaves a gap's count and joins another's.
            change = 1 - 2 * open_bins[gaps]
            change += np.where(gaps > length, 2 * open_bins[gaps - length] + 1, 0)
            best = int(change.argmin())
            if change[best] <= least:
                gap = int(gaps[best])
        if gap < 0:
            chosen, left, made = made, capacity - length, made + 1
        else:
            open_bins[gap] -= 1
            chosen, left = bins[gap].popleft(), gap - length
        if left:
            open_bins[left] += 1
            bins[left].append(chosen)
        sequence[i], offset[i] = chosen, capacity - left - length
    return sequence, offset


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Written pieces, numbered by ``row``, with ``sequence_id`` and ``offset``."""
    partial = F.col("length") < capacity
    lanes = max(1, -(-pieces.filter(partial).count() // LANE_ROWS))
    whole = pieces.filter(~partial).select(
        "*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    def pack(lane: pd.DataFrame) -> pd.DataFrame:
        lane = lane.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        sequence, offset = place(lane["length"].to_numpy(), capacity)
        first = int(lane["lane"].iloc[0]) << 32
        return lane.drop(columns="lane").assign(sequence_id=first + sequence, offset=offset)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.filter(partial).withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(lanes)))
    packed = dealt.groupBy("lane").applyInPandas(pack, f"{schema}, sequence_id long, offset long")
    return whole.unionByName(packed)


def _written_pieces(docs: DataFrame, with_ids: bool, *encoding, remembered: int | None = None) -> DataFrame:
    pieces = encoded_pieces(docs, *encoding, with_ids=with_ids, remembered=remembered)
    return written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")


def packed_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    remembered: int | None = None,
) -> DataFrame:
    """A row per piece: what it is, and the sequence and offset where it goes."""
    pieces = _written_pieces(docs, False, tokenizer, capacity, end_id, remembered=remembered)
    return pack_pieces(pieces, capacity).drop("row")


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, ids as binary."""
    pieces = _written_pieces(docs, True, tokenizer, capacity, end_id)
    placed = pack_pieces(pieces.drop("ids"), capacity).select("row", "sequence_id", "offset")
    inside = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return placed.join(pieces.select("row", "ids"), "row").groupBy("sequence_id").agg(
        F.unhex(F.array_join(F.transform(inside, lambda p: p["ids"]), "")).alias("ids")
    )


def op10_sum_of_squares_packing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return packed_documents(docs, tokenizer_file()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


QUERIES = {"op10_sum_of_squares_packing": op10_sum_of_squares_packing}
