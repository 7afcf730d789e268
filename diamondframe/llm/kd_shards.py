"""Sharding by a k-d tree: split at weighted medians of the widest dimension.

Each row has four metadata dimensions that follow from its text: bytes, bytes per character,
characters per line, and characters per blank, each as a part of its range over the table. A
node of the tree holds a number of shards. A level splits every node at once along its widest
dimension, the one with the largest standard deviation, at the point that gives each side its
part of the bytes. The point is read digit by digit from histograms that are summed before
the shuffle; rows are never sorted or moved for it. Below the value of the dimension a
key goes on with the checksum of the text and then with a hash of the doc_id: equal texts stay
together unless they straddle a median, and a group with a third of all rows can still be split.

Columns and rows only. The nodes of a level and the split of each are rows of a written table,
which the planner broadcasts only while it is small; a node has at most ``2 ** DIGITS[0]`` bins
in a histogram. The driver knows the number of shards and of levels, so a tree down to a
target of bytes may have any number of leaves.

Defined results: a missing text has no bytes; rows without doc_id are placed like any
other, repeated rows too; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from diamondframe.llm.common import byte_length, id_key, read_table, text_value
from diamondframe.session import written

SHARDS = 16
#: A key has 15 bits of a dimension, 32 of the checksum and 16 of the doc_id, read digit by digit.
DIGITS = (13, 13, 13, 12, 12)
KEY_BITS = sum(DIGITS)
DIMENSIONS = ("d_bytes", "d_width", "d_line", "d_blank")
#: The largest value of a dimension.
RANGE = (1 << 15) - 1
SLOT_ROWS = 4096


def _without(text: Column, character: str) -> Column:
    return F.length(F.replace(text, F.lit(character), F.lit("")))


def _metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tie, and the dimensions, each from 0 to ``RANGE`` over the table."""
    text = text_value()
    n_bytes, n_chars = byte_length(text), F.length(text).cast("long")
    crc = F.crc32(text)
    measured = {
        "d_bytes": F.log2(n_bytes + 1),
        "d_width": n_bytes / F.greatest(n_chars, F.lit(1)),
        "d_line": F.log2(n_chars / (n_chars - _without(text, "\n") + 1) + 1),
        "d_blank": F.log2(n_chars / (n_chars - _without(text, " ") + 1) + 1),
    }
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (n_bytes + 1).alias("size"),
            crc.alias("text_crc32"),
            (crc * 65536 + F.pmod(F.xxhash64(id_key()), F.lit(65536))).alias("tie"),
            *[x.cast("double").alias(d) for d, x in measured.items()],
        ),
        "shard-metadata",
    )
    found = rows.agg(*[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return rows.withColumns({d: scaled(F.col(d), found[f"lo_{d}"], found[f"hi_{d}"]) for d in DIMENSIONS})


def scaled(value: Column, low: float | None, high: float | None) -> Column:
    if low is None or low == high:
        return F.lit(0).cast("long")
    return F.floor((value - low) / (high - low) * RANGE).cast("long")


def _widest(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shards, left shards, widest dimension and bytes wanted on the left, of nodes to split."""
    sums = rows.groupBy("node").agg(
        F.sum("size").alias("size"), F.count("*").alias("n"),
        *[f.alias(name) for d in DIMENSIONS for f, name in (
            (F.sum(d), f"s_{d}"), (F.sum((F.col(d) * F.col(d)).cast("decimal(20,0)")), f"q_{d}"),
        )],
    )
    # n times the variance; exact in whole numbers, so it is the same in any partitioning.
    def times_variance(d: str) -> Column:
        total = F.col(f"s_{d}").cast("decimal(19,0)")
        return F.col(f"q_{d}").cast("decimal(30,0)") * F.col("n") - total * total

    spread = {d: times_variance(d) for d in DIMENSIONS}
    most = F.greatest(*spread.values())
    dimension = reduce(lambda rest, k: F.when(spread[DIMENSIONS[k]] == most, k).otherwise(rest),
                       reversed(range(len(DIMENSIONS))), F.lit(0))
    left = F.floor(F.col("shards") / 2)
    found = nodes.filter("shards > 1").join(sums, "node")
    return found.select(
        "node", "shards", left.alias("left"), dimension.alias("dimension"),
        (F.col("size").cast("double") * left / F.col("shards")).alias("wanted"), F.lit(0).cast("long").alias("prefix"),
    )


def _key() -> Column:
    """The row's key along the widest dimension of its node."""
    value = reduce(lambda rest, k: F.when(F.col("dimension") == k, F.col(DIMENSIONS[k])).otherwise(rest),
                   range(len(DIMENSIONS)), F.lit(0).cast("long"))
    return value * F.lit(1 << 48) + F.col("tie")


def _splits(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes to split, with ``prefix``: the first key that goes to the right."""
    state, below = written(_widest(rows, nodes), "shard-widest"), KEY_BITS
    for width in DIGITS:
        above, below = below, below - width
        keyed = rows.join(state, "node").withColumn("key", _key())
        inside = F.shiftright("key", above) == F.col("prefix") if above < KEY_BITS else F.lit(True)
        digit = F.shiftright("key", below).bitwiseAND((1 << width) - 1)
        bins = keyed.filter(inside).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("in_bin"))
        # The first bin that reaches what is wanted on the left, or the last one.
        whole = Window.partitionBy("node")
        upto = bins.select(
            "*", F.sum("in_bin").over(whole.orderBy("digit")).alias("upto"), F.max("digit").over(whole).alias("last")
        ).join(state, "node")
        reaching = upto.filter((F.col("upto") >= F.col("wanted")) | (F.col("digit") == F.col("last")))
        first = reaching.groupBy(*state.columns).agg(
            F.min(F.struct("digit", "in_bin", "upto")).alias("bin")
        )
        wanted = F.col("wanted") - (F.col("bin.upto") - F.col("bin.in_bin"))
        prefix = F.shiftleft("prefix", width) + F.col("bin.digit")
        if below == 0:
            # The last bin goes to the side that it is nearer to.
            prefix = prefix + F.when(2 * wanted >= F.col("bin.in_bin"), 1).otherwise(0)
        chosen = {"wanted": wanted, "prefix": prefix.cast("long")}
        state = written(first.select(*[chosen.get(c, F.col(c)).alias(c) for c in state.columns]), "shard-digits")
    return state


def kd_shards(docs: DataFrame, n_shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row.

    Shards are numbered from 0 and have near equal bytes. Their number is given, or follows
    from the bytes a leaf should reach. Slots number a shard's rows without gaps.
    """
    # The root is written with the rows: as a literal it would turn the first joins into products.
    rows = written(_metadata(docs).withColumn("node", F.lit(0).cast("long")), "shard-dimensions")
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    if n_shards is None:
        n_shards = max(1, -(-(total["size"] or 0) // target_bytes))
    # A node is known by its first shard. After each level the larger halves have half as many.
    nodes = docs.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("node"), F.lit(n_shards).cast("long").alias("shards")
    )
    current = rows
    for _ in range((n_shards - 1).bit_length()):
        splits = _splits(current, nodes)
        joined = current.join(splits.select("node", "left", "dimension", "prefix"), "node", "left")
        right = F.col("prefix").isNotNull() & (_key() >= F.col("prefix"))
        node = F.when(right, F.col("node") + F.col("left")).otherwise(F.col("node"))
        # Written, or the next level's plan would hold this one's many times over.
        current = written(
            joined.select(*[c for c in current.columns if c != "node"], node.alias("node")), "shard-nodes"
        )
        # A node without rows is in no split and ends here.
        halves = F.explode(F.array(
            F.struct(F.col("node"), F.col("left").alias("shards")),
            F.struct((F.col("node") + F.col("left")).alias("node"), (F.col("shards") - F.col("left")).alias("shards")),
        ))
        nodes = splits.select(halves.alias("half")).select("half.*")
    placed = current.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"))
    return _slots(placed, total["n"], n_shards)


def _slots(placed: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """Number the rows of a shard in runs of a few thousand, after the rows of the runs before."""
    runs = max(1, -(-n_rows // (n_shards * SLOT_ROWS)))
    # The row's place in the written table spreads rows that are alike.
    run = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(runs))
    keyed = written(placed.withColumn("run", run), "shard-runs")
    counts = keyed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")),
        "shard-starts",
    )
    inside = Window.partitionBy("shard", "run").orderBy("text_crc32", "doc_id")
    numbered = keyed.withColumn("n", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("n")).cast("long").alias("slot"),
    )


def op9_kd_shards(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return kd_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op9_kd_shards": op9_kd_shards}
