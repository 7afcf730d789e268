"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points has a rolling hash. Of every ``WINDOW`` consecutive hashes the
smallest is chosen, the rightmost of equals. A fingerprint is the chosen hashes with their
positions, so any passage of ``GRAM + WINDOW - 1`` code points that two texts share gives them a
common hash, and the positions tell where it stands in each. Likeness of two fingerprints is the
share of common hashes among all of theirs.

``edit_likeness`` holds each text against an edited one, whose last quarter is the beginning of the
next document, and against the next document itself. The next document is found without a
sort of the whole table in one task: ranges of the order are bounded by their first rows, which a
narrow pass finds, and each first row travels to its own range and to the one before. The driver
holds one (doc_id, hash) per range, a fixed multiple of the shuffle partitions. Texts cross
that one shuffle compressed; a task holds two of them at a time.

Defined results: a missing text is empty; an empty text has an empty fingerprint, like only to
another empty one (1); a text shorter than a gram is one gram, and one with fewer hashes than a
window is one window; documents are in the order of doc_id, missing first, then of the hash of the text;
rows with equal doc_id and text are one document and get equal results; a table of one document
is its own next; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from diamondframe.llm.byte_windows import mix
from diamondframe.llm.common import id_key, id_value, read_table, release_memory, text_value

GRAM, WINDOW = 16, 33
#: Windows that are worked on at once, and bytes of results that are handed on at once.
SEGMENT, BYTES_OUT = 1 << 19, 1 << 22
PACKED_LEVEL = 3
#: Ranges for each shuffle partition, so that partitions get about equal numbers of rows.
RANGES = 4
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Of every run of ``gram`` code points: a polynomial in their mixed values, mixed again."""
    single = mix(codes.astype(np.uint64) + _U(1))
    # Hashes of 1, 2, 4 ... code points; those of which ``gram`` is the sum are put together.
    whole, covered, length = None, 0, 1
    while True:
        if gram & length:
            if whole is None:
                whole = single
            else:
                n = len(codes) - covered - length + 1
                whole = whole[:n] * _U(pow(_BASE, length, 2**64)) + single[covered : covered + n]
            covered += length
        if covered == gram:
            return mix(whole)
        single = single[:-length] * _U(pow(_BASE, length, 2**64)) + single[length:]
        length *= 2


def _smallest(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the rightmost smallest of a window, in order."""
    value, at, length = hashes, np.arange(len(hashes)), 1
    while length < window:
        step = min(length, window - length)
        right = value[step:] <= value[:-step]
        value = np.where(right, value[step:], value[:-step])
        at = np.where(right, at[step:], at[:-step])
        length += step
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def winnow(codes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, in ascending order of position."""
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gram = min(gram, len(codes))
    n_hashes = len(codes) - gram + 1
    window = min(window, n_hashes)
    hashes, positions = [], []
    for at in range(0, n_hashes - window + 1, SEGMENT):
        part = gram_hashes(codes[at : at + SEGMENT + window + gram - 2], gram)
        chosen = _smallest(part, window)
        if positions and chosen[0] + at == positions[-1][-1]:
            chosen = chosen[1:]
        hashes.append(part[chosen])
        positions.append(chosen + at)
    # A segment may choose nothing new.
    return np.concatenate(hashes), np.concatenate([p for p in positions if len(p)])


def as_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    """18 hex digits for each choice: 16 of the hash and 2 of the steps from the choice before."""
    rows = np.empty((len(hashes), 9), np.uint8)
    rows[:, :8] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 8] = np.diff(positions, prepend=0)
    return rows.tobytes().hex()


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a fingerprint written by ``as_text``."""
    rows = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 9)
    return np.ascontiguousarray(rows[:, :8]).view(">u8")[:, 0].astype(np.uint64), np.cumsum(rows[:, 8], dtype=np.int64)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Common hashes by all hashes, of two sorted sets; 1 for two empty ones."""
    if not len(one) and not len(other):
        return 1.0
    common = len(np.intersect1d(one, other, assume_unique=True))
    return common / (len(one) + len(other) - common)


def _checked(gram: int, window: int) -> None:
    if gram < 1 or not 1 <= window <= 255:
        raise ValueError("a gram has at least one code point, a window 1 to 255 hashes")


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, hashes and positions of every row."""
    _checked(gram, window)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [code_points(t.as_py()) for t in batch.column(1)]
            found = [winnow(t, gram, window) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "hashes": pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())),
                "positions": pa.array([p for _, p in found], pa.list_(pa.int64())),
            })

    rows = docs.select(F.col("doc_id").cast("long"), text_value().alias("text"))
    return rows.mapInArrow(choose, "doc_id long, n_chars long, hashes array<long>, positions array<long>")


def _range_heads(keyed: DataFrame) -> list[tuple[int, int]]:
    """The first (id, version) of each range of the order."""
    n = RANGES * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.select("id", "version").repartitionByRange(n, "id", "version")
    heads = dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("id", "version")).alias("head"))
    return sorted((r["head"]["id"], r["head"]["version"]) for r in heads.collect())


def _dealt(keyed: DataFrame, heads: list[tuple[int, int]]) -> DataFrame:
    """Distinct documents by range, each range followed by the first one of the next.

    Rows with equal id and text are counted within a batch.
    """
    names = ["range", "beyond", "id", "version", "n", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=PACKED_LEVEL)
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            texts, counted, out = batch.column(2).cast(pa.binary()), Counter(keys), []
            first = {key: row for row, key in reversed(list(enumerate(keys)))}
            for key, row in first.items():
                of = bisect_right(heads, key) - 1
                packed = compressor.compress(texts[row].as_py())
                out.append((of, 0, *key, counted[key], packed))
                if heads[of] == key:
                    out.append(((of - 1) % len(heads), 1, *key, 0, packed))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, names)

    types = [pa.int64()] * 5 + [pa.binary()]
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.mapInArrow(deal, "range long, beyond long, id long, version long, n long, text binary")
    return rows.repartition(n, "range").sortWithinPartitions("range", "beyond", "id", "version")


class _Results:
    """Rows of results, handed on as soon as they are large enough."""

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, n: int) -> Iterator[pa.RecordBatch]:
        for _ in range(n):
            self.rows.append(row)
            self.size += 200 + len(row[3]) + len(row[4])
            if self.size > BYTES_OUT:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*self.rows)], self.names)
            self.rows, self.size = [], 0


def edit_likeness(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The edited text has its last quarter (rounded down) replaced by as many code points, or all,
    of the beginning of the next document.
    """
    _checked(gram, window)
    keyed = docs.select(
        id_key().alias("id"), F.xxhash64(text_value()).alias("version"), text_value().alias("text")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, results, now = zstandard.ZstdDecompressor(), _Results(), None

        def finished(now, text, chosen) -> Iterator[pa.RecordBatch]:
            (_, _, doc, _), n, own, (hashes, positions, known) = now
            codes, last = code_points(own), len(own) // 4
            edited = own[: len(own) - last] + text[:last]
            kept = len(own) - last
            edited_codes = np.concatenate([codes[:kept], code_points(text[:last])])
            new = winnow(edited_codes, gram, window)
            yield from results.add((
                doc, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                as_text(hashes, positions), as_text(*new),
                likeness(known, np.unique(new[0])), likeness(known, chosen[2]),
            ), n)

        for batch in batches:
            texts = batch.column(5)
            for row, (*key, n) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)))):
                if now and now[0] == tuple(key):
                    now = (now[0], now[1] + n, *now[2:])
                    continue
                text = unpack.decompress(texts[row].as_py()).decode("utf-8", "surrogatepass")
                hashes, positions = winnow(code_points(text), gram, window)
                chosen = (hashes, positions, np.unique(hashes))
                if now and not now[0][1]:
                    yield from finished(now, text, chosen)
                now = (tuple(key), n, text, chosen)
        yield from results.flush()
        release_memory()

    heads = _range_heads(keyed)
    done = _dealt(keyed, heads).mapInArrow(compare, _Results.schema)
    return done.select(id_value("id").alias("doc_id"), *_Results.names[1:])


def op11_winnowing(spark, sf_dir):
    return edit_likeness(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_winnowing": op11_winnowing}
