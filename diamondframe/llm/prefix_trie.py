"""Conversation prefix trie by ROLLUP over positional turn columns.

A conversation becomes rows of ``WIDTH`` positional columns, one turn id in each: the first
block holds its first turns, and a long one goes on in further blocks, each keyed by the node
that the block before ended in. One ``GROUP BY block, node, ROLLUP(t1 .. t8)`` aggregates the
prefixes of every length in every block together; ``grouping_id`` tells the length. Prefixes are
reduced before the shuffle, so a first turn that a third of all conversations share costs no
more than others.

* A turn id is a 128-bit hash of role and text. A node's key is the exclusive or of the hashes of
  (depth, turn id) on its path. So the key before any block is a running sum over the blocks of
  a conversation, taken in chunks, and no block waits for the one before it.
* What a node needs from its whole subtree comes from a second ROLLUP of the same rows. Each
  node is represented by its smallest member; its weight is put on that member's row, at its
  depth, and the members of a prefix add up what they represent from that depth on.
* The ids that end in a node are joined in chunks of consecutive ids, and a streaming pass over
  the sorted chunks makes the digest.

Defined results: rows without conv_id belong to no conversation and add nothing; a missing turn
number comes first; turns with equal numbers are in the order of their id; repeated rows are turns
of their own; a missing role or text is empty; an empty table gives an empty table; only conv_id,
turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from diamondframe.llm.common import read_table, text_value
from diamondframe.operators.ordered import number_in_order
from diamondframe.session import written

#: Positional columns of a block; blocks of a conversation, and ids, that one task strings together.
WIDTH, CHUNK_BLOCKS, CHUNK_IDS = 8, 1024, 4096
_TURNS = [f"t{k}" for k in range(1, WIDTH + 1)]
_KEY = ["depth", "ka", "kb"]
_NO_TURN = -(2**63)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), the turn's id (a, b) and its code points."""
    role, text = text_value("role"), text_value()
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(_NO_TURN)).alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), role, text).alias("b"),
        F.length(text).cast("long").alias("chars"),
    )
    return number_in_order(turns, ["conv"], ["turn", "a", "b"], "pos").drop("turn")


def rebuilt(turns: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, n_turns, a, b, chars) and conversations (conv, n_turns) with a shared opening.

    A conversation c starts with the first h turns of conversation c - c % ``family``, all if it
    has fewer and none if there is no such one, and goes on with its own after the first h;
    h is the checksum of c modulo ``most``.
    """
    turns, conv = written(turns, "ordered-turns"), F.col("conv")
    # A conversation that lends its opening gives at most ``most - 1`` turns.
    entry = F.struct("pos", "a", "b", "chars")
    lent = turns.filter((conv % family == 0) & (F.col("pos") < most)).groupBy("conv").agg(
        F.sort_array(F.collect_list(entry)).alias("opening")
    )
    own = turns.groupBy("conv").agg(F.max("pos").cast("long").alias("n_own")).select(
        "conv", "n_own", (conv - conv % family).alias("first"),
        (F.crc32(conv.cast("string")) % most).cast("int").alias("h"),
    )
    taken = F.least("h", F.coalesce(F.array_size("opening"), F.lit(0)))
    members = own.join(lent.withColumnRenamed("conv", "first"), "first", "left").select(
        "conv", "h", "opening", taken.alias("taken"),
        (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"),
    )
    members = written(members, "rebuilt-conversations")
    opened = members.select("conv", "n_turns", F.explode(F.slice("opening", 1, F.col("taken"))).alias("t"))
    rest = turns.join(members.select("conv", "h", "taken", "n_turns"), "conv").filter("pos > h")
    shifted = (F.col("taken") + F.col("pos") - F.col("h")).cast("long")
    both = opened.select("conv", F.col("t.pos").cast("long").alias("pos"), "n_turns", "t.a", "t.b", "t.chars").unionByName(
        rest.select("conv", shifted.alias("pos"), "n_turns", "a", "b", "chars")
    )
    return both, members.select("conv", "n_turns")


def _mark(depth: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """What a turn adds to the key of its path."""
    return F.xxhash64(depth, a, b), F.xxhash64(b, a, depth)


def _strung(blocks: DataFrame, column: str, total, join, back: bool) -> Column | DataFrame:
    """Add ``prior``: ``total`` of ``column`` over the conversation's blocks before (after) each.

    Chunks of blocks are strung together inside, and only the totals of chunks of a long
    conversation across.
    """
    order = (lambda c: F.col(c).desc()) if back else F.col
    rows = blocks.withColumn("chunk", F.floor(F.col("block") / CHUNK_BLOCKS))
    inside = Window.partitionBy("conv", "chunk").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv").orderBy(order("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    long_ones = rows.filter(F.col("n_turns") > CHUNK_BLOCKS * WIDTH)
    outer = long_ones.groupBy("conv", "chunk").agg(total(column).alias("whole")).select(
        "conv", "chunk", total("whole").over(across).alias("outer")
    )
    zero = F.lit(0).cast("long")
    joined = rows.withColumn("inner", total(column).over(inside)).join(outer, ["conv", "chunk"], "left")
    prior = join(F.coalesce("inner", zero), F.coalesce("outer", zero))
    return joined.withColumn("prior", prior).drop("inner", "outer", "chunk")


def turn_blocks(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row per conversation and block: turn columns, and the key (pa, pb) of the node before."""
    level = (F.col("pos") - 1) % WIDTH + 1
    za, zb = _mark(F.col("pos"), F.col("a"), F.col("b"))
    at = lambda k, c: F.max(F.when(level == k, F.col(c))).alias(f"{c}{k}")
    dealt = turns.withColumn("block", F.floor((F.col("pos") - 1) / WIDTH)).groupBy("conv", "block").agg(
        F.max("n_turns").alias("n_turns"), F.bit_xor(za).alias("xa"), F.bit_xor(zb).alias("xb"),
        *[at(k, c) for k in range(1, WIDTH + 1) for c in ("a", "b", "chars")],
    )
    turn = lambda k: F.when(
        F.col(f"a{k}").isNotNull(),
        F.struct(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b"), F.col(f"chars{k}").alias("chars")),
    ).alias(f"t{k}")
    full = dealt.select("conv", "block", "n_turns", "xa", "xb", *[turn(k) for k in range(1, WIDTH + 1)])
    none = members.filter("n_turns = 0").select(
        "conv", F.lit(0).cast("long").alias("block"), "n_turns",
        *[F.lit(0).cast("long").alias(x) for x in ("xa", "xb")],
        *[F.lit(None).cast("struct<a: long, b: long, chars: long>").alias(t) for t in _TURNS],
    )
    blocks = written(full.unionByName(none), "turn-blocks")
    xor = lambda x, y: x.bitwiseXOR(y)
    keyed = _strung(blocks, "xa", F.bit_xor, xor, False).withColumnRenamed("prior", "pa")
    return _strung(keyed, "xb", F.bit_xor, xor, False).withColumnRenamed("prior", "pb")


def _rollup(blocks: DataFrame, sums: list[str]) -> DataFrame:
    """All nodes: depth, key, key of the parent, level, block and the aggregates."""
    turns = ", ".join(_TURNS)
    more = "".join(f", sum({s}) AS {s}" for s in sums)
    grouped = blocks.sparkSession.sql(
        f"SELECT block, pa, pb, {turns}, {WIDTH} - bit_count(grouping_id()) AS level, count(*) AS n_convs, "
        f"min(conv) AS conv_id, max(n_turns) AS deepest{more} "
        f"FROM {{blocks}} GROUP BY block, pa, pb, ROLLUP ({turns})",
        blocks=blocks,
    )
    # A conversation that has ended leaves the other columns empty: that prefix was counted before.
    filled = reduce(lambda x, y: x + y, [F.col(t).isNotNull().cast("int") for t in _TURNS])
    nodes = grouped.filter((F.col("level") == filled) & ((F.col("level") > 0) | (F.col("block") == 0)))
    last = F.coalesce(*[F.col(t) for t in reversed(_TURNS)])
    key = {"ka": F.col("pa"), "kb": F.col("pb")}
    for k, t in enumerate(_TURNS, 1):
        marks = _mark(F.col("block") * WIDTH + k, F.col(f"{t}.a"), F.col(f"{t}.b"))
        for name, mark in zip(key, marks):
            key[name] = key[name].bitwiseXOR(F.when(F.col(t).isNotNull(), mark).otherwise(F.lit(0).cast("long")))
    depth = (F.col("block") * WIDTH + F.col("level")).cast("long")
    keyed = nodes.select("*", depth.alias("depth"), last.alias("last"), *[c.alias(n) for n, c in key.items()])
    up = dict(zip(("ua", "ub"), _mark(F.col("depth"), F.col("last.a"), F.col("last.b"))))
    above = [F.when(F.col("depth") > 0, F.col(k).bitwiseXOR(m)).alias(n) for (n, m), k in zip(up.items(), key)]
    return keyed.select(*_KEY, *above, "level", "block", "last.chars", "conv_id", "n_convs", "deepest", *sums)


def _weights(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of smallest members: their saved tokens by level of a block, and where they start to be ones."""
    saved = F.coalesce((F.col("n_convs") - 1) * F.col("chars"), F.lit(0))
    by_level = [
        F.sum(F.when(F.col("level") == k, saved).otherwise(F.lit(0))).cast("long").alias(f"w{k}")
        for k in range(1, WIDTH + 1)
    ]
    weights = nodes.filter((F.col("n_convs") > 1) & (F.col("depth") > 0)).groupBy(
        F.col("conv_id").alias("conv"), "block"
    ).agg(*by_level)
    leaf = (F.col("deepest") == F.col("depth")).cast("long")
    starts = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("start"), F.max(leaf).alias("n_leaves")
    )
    return weights, starts


def _measured(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blocks with what their conversation adds to a node of each level: leaves, children, tokens."""
    weights, starts = _weights(nodes)
    none = F.lit(0).cast("long")
    names = [f"w{k}" for k in range(1, WIDTH + 1)]
    found = blocks.join(written(weights, "trie-weights"), ["conv", "block"], "left")
    found = found.join(written(starts, "trie-starts"), "conv", "left")
    total = reduce(lambda x, y: x + y, [F.coalesce(w, none) for w in names])
    found = found.withColumns({w: F.coalesce(w, none) for w in names} | {
        "total": total, "n_leaves": F.coalesce("n_leaves", none),
    })
    strung = _strung(written(found, "trie-measures"), "total", F.sum, lambda x, y: x + y, True)
    measures = {}
    for k in range(WIDTH + 1):
        measures[f"s{k}"] = reduce(lambda x, y: x + y, [F.col(w) for w in names[max(k - 1, 0):]], F.col("prior"))
        child = F.col("block") * WIDTH + k + 1
        stands = (F.col("start") <= child) & (F.col("n_turns") >= child)
        measures[f"c{k}"] = F.coalesce(stands.cast("long"), none)
    return strung.select("conv", "block", "n_turns", "pa", "pb", *_TURNS, "n_leaves",
                         *[c.alias(n) for n, c in measures.items()])


def _ends(blocks: DataFrame) -> DataFrame:
    """depth, ka, kb and ends_sha256 of the nodes in which conversations end."""
    left = F.col("n_turns") - F.col("block") * WIDTH
    last = blocks.filter((left <= WIDTH) & ((left > 0) | (F.col("n_turns") == 0)))
    ends = last.select(
        F.col("n_turns").alias("depth"), F.col("pa").bitwiseXOR(F.col("xa")).alias("ka"),
        F.col("pb").bitwiseXOR(F.col("xb")).alias("kb"), "conv",
        F.floor(F.col("conv") / CHUNK_IDS).alias("chunk"),
    )
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    pieces = ends.groupBy(*_KEY, "chunk").agg(F.array_join(ids, ",").alias("piece"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for *own, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if own == node:
                    sha.update(b",")
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = own, hashlib.sha256()
                sha.update(piece.encode())
            yield from _rows(out)
        if node:
            yield from _rows([(*node, sha.hexdigest())])

    def _rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            *longs, digests = zip(*out)
            columns = [pa.array(c, pa.int64()) for c in longs] + [pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*_KEY, "ends_sha256"])

    dealt = pieces.repartition(*[F.col(c) for c in _KEY]).sortWithinPartitions(*_KEY, "chunk")
    return dealt.mapInArrow(digest, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row per node of the trie of conversations, the root of all included.

    ``turns`` holds conv, pos from 1, n_turns, a turn id (a, b) and chars; ``members`` conv and
    n_turns of all conversations. A node is known by depth and key (ka, kb); conv_id is its
    smallest member.
    """
    blocks = written(turn_blocks(turns, members), "keyed-blocks")
    nodes = written(_rollup(blocks, []), "trie-nodes")
    levels = range(WIDTH + 1)
    sums = ["n_leaves", *[f"s{k}" for k in levels], *[f"c{k}" for k in levels]]
    found = written(_rollup(_measured(blocks, nodes), sums), "trie-sums")
    pick = lambda name: F.get(F.array(*[F.col(f"{name}{k}") for k in levels]), F.col("level"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("ka").alias("ua"), F.col("kb").alias("ub"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    ends = written(_ends(blocks), "trie-ends")
    joined = found.join(parents, ["depth", "ua", "ub"], "left").join(ends, _KEY, "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", pick("c").alias("n_children"), "n_leaves",
        pick("s").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "ka", "kb",
    )


def op12_prefix_trie(spark, sf_dir):
    conversations = read_table(spark, sf_dir, "conversations")
    return prefix_trie(*rebuilt(ordered_turns(conversations))).drop("ka", "kb")


QUERIES = {"op12_prefix_trie": op12_prefix_trie}

ORACLES = {
    "op12_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  -- The checksum of the decimal id, bit by bit.
  SELECT c, c - c % 100 AS first, xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda x, i:
             CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)
         ), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turns)
), rebuilt AS (
  SELECT c, 0 AS part, pos, t FROM convs JOIN turns ON conv_id = first AND pos <= h
  UNION ALL
  SELECT c, 1 AS part, pos, t FROM convs JOIN turns ON conv_id = c AND pos > h
), paths AS (
  SELECT c, coalesce(list(t ORDER BY part, pos) FILTER (WHERE t IS NOT NULL), []) AS path
  FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c
), nodes AS (
  SELECT path[1:d] AS node, d AS depth, min(c) AS conv_id, count(*) AS n_convs
  FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM paths) GROUP BY 1, 2
), ends AS (
  SELECT path AS node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM paths GROUP BY path
), children AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), weighed AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, coalesce((n_convs - 1) * length(node[-1].text), 0) AS saved
  FROM nodes n LEFT JOIN children USING (node)
), subtrees AS (
  SELECT node[1:d] AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM weighed) GROUP BY 1
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM weighed w JOIN subtrees s ON s.node = w.node
LEFT JOIN nodes p ON w.depth > 0 AND p.depth = w.depth - 1 AND p.node = w.node[1:w.depth - 1]
LEFT JOIN ends e ON e.node = w.node
""",
}
