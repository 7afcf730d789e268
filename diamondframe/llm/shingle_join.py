"""N-gram Jaccard join by R-trees over count vectors.

A text is the set of its word shingles; two link when their sets have a Jaccard similarity of
at least ``percent``. The shingles of a set are hashed into groups, the counts per group are a
point, and points are indexed in an R-tree (``count_tree``): the sum of the smaller coordinates
bounds the size of an intersection from above, for boxes and for points, and the pairs that
survive are verified on the whole sets.

One tree over everything would send every set to nearly all of its pages. So sets are first
brought into clusters that no link leaves: sets that link share a key (``shingles.shared_keys``,
exact by a pigeonhole argument), and a cluster is a component of the sets with a common key whose
points allow a link. Without the points, texts that merely have a passage in common would chain to
one cluster over most of a large table.
A cluster is dealt over leaves of at most about ``LEAF_SETS`` sets of one band of sizes; every
two leaves that may hold linked sets meet in a task, which holds their two trees. Equal sets are one all along. A task hands
on a row per set, with the smallest one it reaches there and the number of its links, never its
pairs.

Defined results: a missing or empty text has no shingles and links with nothing; fewer words
than a shingle are one shingle of their own length; rows without doc_id are one document that
comes first, with a missing id in results; rows with equal doc_id are one document, which
links with whatever one of its texts links with; an empty table gives an empty table; only
doc_id and text are read. ``one_text_of_each_group`` goes by texts instead: there a doc_id links
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from diamondframe.llm.common import BLANKS, id_key, id_value, read_table, release_memory, text_value
from diamondframe.llm.components import components
from diamondframe.llm.count_tree import CountTree, links
from diamondframe.llm.shingles import GROUPS, count_vector, digest, least_common, shared_keys, shingle_set
from diamondframe.session import written

LEAF_SETS, LEAF_SHINGLES = 4096, 2_000_000
ROWS_OUT = 1 << 16
#: Of a key with more texts than this, the texts stay together whatever their points.
KEY_TEXTS = 1 << 14
#: Elements per coordinate of a point, up to so many coordinates: with more elements in each, the
#: bound would let unrelated sets pass.
POINT_COUNT, POINT_GROUPS = 8, 1 << 15
#: Numbers in a block of compared points.
BLOCK = 1 << 20


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_value()
    return docs.select(id_key().alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


def _described(keyed: DataFrame, width: int) -> DataFrame:
    """A row per text: size of its set, two hashes of it, and its point."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(2).cast(pa.binary())]
            found = [(len(s), *digest(s)) for s in sets]
            columns = zip(*found) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *[pa.array(c, pa.int64()) for c in columns],
                 pa.array([_point(s) for s in sets], pa.binary())],
                ["doc", "version", "n", "d1", "d2", "point"],
            )
        release_memory()

    return keyed.mapInArrow(describe, "doc long, version long, n long, d1 long, d2 long, point binary")


def _point(hashes: np.ndarray) -> bytes:
    """The count vector behind the bytes of a number; large sets have more coordinates.

    Those of half as many are the sums of the first and second half.
    """
    groups = GROUPS
    while len(hashes) > POINT_COUNT * groups and groups < POINT_GROUPS:
        groups *= 2
    counts = count_vector(hashes, groups)
    kind = np.min_scalar_type(counts.max())
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def _points(packed: list[bytes]) -> np.ndarray:
    """Points side by side, in the fewest coordinates of any."""
    made = [np.frombuffer(p, dtype=f"u{p[0]}", offset=1) for p in packed]
    least = min(map(len, made))
    return np.stack([p if len(p) == least else p.reshape(-1, least).sum(axis=0, dtype="u4") for p in made])


def _keys(keyed: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, version): the keys of every text. They go into a shuffle and are not written before."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            versions = batch.column(1).to_numpy()
            found = [
                shared_keys(shingle_set(t.as_py(), width), percent)
                for t in batch.column(2).cast(pa.binary())
            ]
            if not found:
                continue
            owner = np.repeat(versions, [len(k) for k in found])
            flat = np.concatenate(found)
            for at in range(0, len(flat), ROWS_OUT):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[at : at + ROWS_OUT]), pa.array(owner[at : at + ROWS_OUT])], ["key", "version"]
                )
        release_memory()

    return keyed.mapInArrow(keys, "key long, version long")


def _sharing(keys: DataFrame) -> DataFrame:
    """(texts, version, head): the texts that have a key in common, each such list of texts once.

    ``texts`` is a hash of the list. A key of more than ``KEY_TEXTS`` texts has no list but a row for
    each text, without ``texts``, and its smallest one as ``head``.
    """

    def lists(keys: np.ndarray, versions: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole keys, in order."""
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(starts, append=len(keys))
        several = np.flatnonzero(sizes > 1)
        if not len(several):
            return
        mixed = versions.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)
        _, once = np.unique(hashes[several], return_index=True)
        chosen = several[once]
        ids = hashes.view(np.int64)[chosen]
        at = np.repeat(starts[chosen], sizes[chosen])
        ends = np.cumsum(sizes[chosen])
        at = at + np.arange(len(at)) - np.repeat(ends - sizes[chosen], sizes[chosen])
        yield of(np.repeat(ids, sizes[chosen]), versions[at])

    def of(texts, versions: np.ndarray, head=None) -> pa.RecordBatch:
        none = pa.nulls(len(versions), pa.int64())
        columns = [none if texts is None else pa.array(texts), pa.array(versions)]
        columns.append(none if head is None else pa.array(np.full(len(versions), head)))
        return pa.RecordBatch.from_arrays(columns, ["texts", "version", "head"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last key of a batch may go on in the next one.
        keys, versions = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        large = head = None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            versions = np.concatenate([versions, batch.column(1).to_numpy()])
            if not len(keys):
                continue
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (versions[1:] != versions[:-1])])
            keys, versions = keys[new], versions[new]
            if large is not None:
                n = int(np.searchsorted(keys, large, "right"))
                if n:
                    yield of(None, versions[:n], head)
                keys, versions = keys[n:], versions[n:]
                if not len(keys):
                    continue
                large = None
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield from whole(keys[:last], versions[:last])
            keys, versions = keys[last:], versions[last:]
            if len(keys) > KEY_TEXTS:
                large, head = keys[0], versions[0]
                yield of(None, versions[1:], head)
                keys, versions = keys[:0], versions[:0]
        if len(keys):
            yield from whole(keys, versions)
        release_memory()

    def whole(keys: np.ndarray, versions: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(starts, append=len(keys))
        for i in np.flatnonzero(sizes > KEY_TEXTS):
            mine = versions[starts[i] : starts[i] + sizes[i]]
            yield of(None, mine[1:], mine[0])
        few = np.repeat(sizes <= KEY_TEXTS, sizes)
        if few.any():
            yield from lists(keys[few], versions[few])

    dealt = keys.repartition("key").sortWithinPartitions("key", "version")
    return dealt.mapInArrow(read, "texts long, version long, head long").distinct()


def _reaching(points: np.ndarray, percent: int) -> np.ndarray:
    """For each point the first one that it reaches by steps between points that allow a link."""
    sizes = points.sum(axis=1, dtype=np.int64)
    first, left = np.full(len(points), -1), np.arange(len(points))
    while len(left):
        front, left = left[:1], left[1:]
        head = front[0]
        first[head] = head
        while len(front) and len(left):
            step = max(1, BLOCK // (points.shape[1] * len(left)))
            at, front = front[:step], front[step:]
            common = np.minimum(points[at, None, :], points[None, left, :]).sum(axis=2, dtype=np.int64)
            near = (common >= least_common(sizes[at, None], sizes[None, left], percent)).any(axis=0)
            first[left[near]] = head
            front, left = np.concatenate([front, left[near]]), left[~near]
    return first


def _near(sharing: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between texts with a key in common whose points allow that they link."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        at, out = None, []

        def done() -> None:
            # Two texts of one hash have two points, so a text may stand twice.
            if sum(map(len, held.values())) > 1:
                versions = np.repeat([*held], [len(p) for p in held.values()])
                first = _reaching(_points([p for some in held.values() for p in some]), percent)
                moved = versions[first] != versions
                out.append((versions[moved], versions[first][moved]))

        for batch in batches:
            for texts, version, point in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if texts != at:
                    done()
                    at, held = texts, {}
                held.setdefault(version, []).append(point)
            if out:
                yield edges(out)
                out = []
        done()
        yield edges(out)
        held.clear()
        release_memory()

    def edges(out: list[tuple]) -> pa.RecordBatch:
        pairs = np.concatenate([np.stack(x) for x in out], axis=1) if out else np.empty((2, 0), dtype=np.int64)
        pairs = np.unique(pairs, axis=1) if pairs.shape[1] else pairs
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    points = described.filter("n > 0").select("version", "point").distinct()
    listed = sharing.filter("texts IS NOT NULL").join(points, "version").select("texts", "version", "point")
    dealt = listed.repartition("texts").sortWithinPartitions("texts")
    apart = sharing.filter("texts IS NULL").select(F.col("version").alias("a"), F.col("head").alias("b"))
    return dealt.mapInArrow(join, "a long, b long").unionByName(apart).distinct()


def _members(described: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """A row per distinct set and meeting of two leaves that it takes part in.

    A leaf holds sets of one cluster and one band of sizes. Sets that link are in the same
    band or in neighbouring ones, so these leaves meet and no others.
    """
    sharing = written(_sharing(keys), "sharing")
    of_cluster = components(_near(sharing, described, percent)).select(
        F.col("node").alias("version"), F.col("component").alias("cluster")
    )
    sets = described.filter("n > 0").drop("point").distinct()
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    distinct = written(
        sets.join(of_cluster, "version").groupBy("cluster", "d1", "d2").agg(
            F.min(F.struct("doc", "version")).alias("first"), F.first("n").alias("n"),
            F.count_distinct("doc").alias("copies"),
        ).select("cluster", "first.doc", "first.version", "n", "copies", band.alias("band")),
        "cluster-sets",
    )
    leaves = F.ceil(F.greatest(F.count("*") / LEAF_SETS, F.sum("n") / LEAF_SHINGLES)).cast("int")
    sizes = distinct.groupBy("cluster", "band").agg(F.count("*").alias("sets"), leaves.alias("leaves"))
    # A cluster has a row per band here.
    bands = Window.partitionBy("cluster").orderBy("band")

    def neighbour(column, step: int):
        return F.when(column("band").over(bands) == F.col("band") + step, column("leaves").over(bands))

    met = written(
        sizes.select(
            "cluster", "band", "sets", "leaves",
            F.coalesce(neighbour(F.lag, -1), F.lit(0)).alias("below"),
            F.coalesce(neighbour(F.lead, 1), F.lit(0)).alias("above"),
        ).filter("sets > 1 or below > 0 or above > 0"),
        "bands",
    )
    leaf, own = F.pmod(F.xxhash64("doc", "version"), "leaves").cast("int"), F.col("band")

    def meetings(count: Column, made) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), count), lambda o: o < count), made)

    def meeting(low, left, high, right) -> Column:
        parts = zip(("low", "left", "high", "right"), (low, left, high, right))
        return F.struct(*[c.cast("int").alias(n) for n, c in parts])

    inside = F.when(F.col("sets") > 1, F.col("leaves")).otherwise(0)
    every = F.concat(
        meetings(inside, lambda o: meeting(own, F.least("leaf", o), own, F.greatest("leaf", o))),
        meetings(F.col("above"), lambda o: meeting(own, F.col("leaf"), own + 1, o)),
        meetings(F.col("below"), lambda o: meeting(own - 1, o, own, F.col("leaf"))),
    )
    placed = distinct.join(met, ["cluster", "band"]).withColumn("leaf", leaf)
    return placed.select("doc", "version", "copies", "cluster", "band", "leaf", every.alias("meetings"))


def _pack(keyed: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [compressor.compress(t.as_py()) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.binary())], ["doc", "version", "packed"]
            )

    return keyed.mapInArrow(pack, "doc long, version long, packed binary")


def _linked(keyed: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, version, root, root_version, n_links): what each set reaches in a task, and its links there."""
    placed = _pack(keyed).join(members, ["doc", "version"])
    group = ["cluster", "low", "left", "high", "right"]
    met = placed.withColumn("meeting", F.explode("meetings")).select(
        "cluster", "meeting.*",
        ((F.col("band") == F.col("meeting.low")) & (F.col("leaf") == F.col("meeting.left"))).alias("is_left"),
        "doc", "version", "copies", "packed",
    )

    def solve(rows: dict[tuple[int, int], tuple[bool, int, bytes]], unpack) -> list[tuple]:
        ids = list(rows)
        sides: dict[bool, list[int]] = {}
        for i, key in enumerate(ids):
            sides.setdefault(rows[key][0], []).append(i)
        sets = [shingle_set(unpack.decompress(rows[key][2]), width) for key in ids]
        trees = [(of, CountTree([sets[i] for i in of])) for _, of in sorted(sides.items())]
        (left, a), (right, b) = trees[0], trees[-1]
        root, count = list(range(len(ids))), [0] * len(ids)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in links(a, b, percent):
            x, y = left[i], right[j]
            count[x] += rows[ids[y]][1]
            count[y] += rows[ids[x]][1]
            x, y = sorted((find(x), find(y)), key=lambda k: ids[k])
            root[y] = x
        return [(*ids[i], *ids[find(i)], count[i]) for i in range(len(ids)) if count[i]]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: dict[tuple[int, int], tuple[bool, int, bytes]] = {}
        at, out, alone = None, [], False

        def done() -> None:
            # Two leaves meet in one task; each leaf meets itself in another.
            if len(held) > 1 and (alone or len({v[0] for v in held.values()}) == 2):
                out.extend(solve(held, unpack))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(group) + 4)]
            for *row, packed in zip(*columns, batch.column(len(group) + 4)):
                if (key := tuple(row[: len(group)])) != at:
                    done()
                    at, held, alone = key, {}, row[1:3] == row[3:5]
                is_left, doc, version, copies = row[len(group) :]
                held[doc, version] = (is_left, copies, packed.as_py())
            if out:
                yield batch_of(out)
                out = []
        done()
        yield batch_of(out)
        held.clear()
        release_memory()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["doc", "version", "root", "root_version", "n_links"]
        )

    dealt = met.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(join, "doc long, version long, root long, root_version long, n_links long")


def jaccard_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, version, n, component, n_links) of every row; ids as in ``id_key``.

    ``component`` is the smallest document that links lead to. ``n_links`` counts the texts that
    a text links with, its copies under other doc_ids included.
    """
    keyed = _keyed(docs)
    described = written(_described(keyed, width), "shingle-sets")
    rows = described.drop("point")
    members = _members(described, _keys(keyed, width, percent), percent)
    found = written(_linked(keyed, members, width, percent), "links")
    classes = written(
        rows.filter("n > 0").groupBy("d1", "d2").agg(
            F.min("doc").alias("first"), F.count_distinct("doc").alias("copies")
        ), "classes",
    )
    copies = rows.join(classes, ["d1", "d2"])
    edges = found.select(F.col("doc").alias("a"), F.col("root").alias("b")).unionByName(
        copies.filter("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b"))
    )
    ends = written(components(edges), "components")
    # The links of a set are known for its first text; its copies have the same.
    of_text = found.groupBy("doc", "version").agg(F.sum("n_links").alias("n_links"))
    of_set = written(
        rows.distinct().join(of_text, ["doc", "version"]).groupBy("d1", "d2")
        .agg(F.max("n_links").alias("n_links")), "set-links",
    )
    joined = (
        rows.join(classes, ["d1", "d2"], "left").join(of_set, ["d1", "d2"], "left")
        .join(ends.withColumnRenamed("node", "doc"), "doc", "left")
    )
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc", "version", "n",
        F.coalesce("component", "doc").alias("component"),
        (F.coalesce(F.col("copies") - 1, zero) + F.coalesce("n_links", zero)).alias("n_links"),
    )


def one_text_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows without all but the first of each group of linked texts; the input's columns.

    The nodes are the distinct sets, so different texts stay apart under one doc_id or without
    one. The first text of a group has the smallest (doc_id, hash); of rows that repeat both, one
    stays. Rows without words all stay.
    """
    keyed = _keyed(docs)
    rows = written(_described(keyed, width), "shingle-sets")
    members = _members(rows, _keys(keyed, width, percent), percent)
    found = written(_linked(keyed, members, width, percent), "links")
    sets = written(
        rows.filter("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc", "version")).alias("first"))
        .select("first.*", F.monotonically_increasing_id().alias("node")), "sets",
    )
    # A set takes part in meetings as its first text.
    roots = sets.select(
        F.col("doc").alias("root"), F.col("version").alias("root_version"), F.col("node").alias("b")
    )
    edges = found.join(sets, ["doc", "version"]).join(roots, ["root", "root_version"])
    ends = written(components(edges.select(F.col("node").alias("a"), "b")), "components")
    first = written(
        sets.join(ends, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("component"))
        .agg(F.min(F.struct("doc", "version")).alias("first"))
        .select("first.doc", "first.version"), "first-of-group",
    )
    text = text_value()
    has_words = text.rlike(f"[^{BLANKS}]")
    of_row = (id_key() == first["doc"]) & (F.xxhash64(text) == first["version"])
    same = Window.partitionBy(first["doc"], first["version"]).orderBy(first["doc"])
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    kept = docs.filter(has_words).join(first, of_row).select(row, F.row_number().over(same).alias("n"))
    return kept.filter("n = 1").select("row.*").unionByName(docs.filter(~has_words))


def op2_shingle_join(spark, sf_dir):
    found = jaccard_components(read_table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select(
        id_value("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        id_value("component").alias("component_id"), "n_links",
    )


QUERIES = {"op2_shingle_join": op2_shingle_join}
