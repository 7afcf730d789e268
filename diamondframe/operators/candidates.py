"""Candidate pitches for a table of requests.

A request is a situation to decide: ``request_id, pitcher, batter, outs, b1, b2, b3,
balls, strikes``. Each operator adds columns or rows; none needs more than the request's
own row and the small profile tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from diamondframe import constants as K
from diamondframe.functions import draws, geometry
from diamondframe.functions.states import state_key
from diamondframe.operators.joins import null_safe_join

TYPE = "pitch_type_condensed"
SITUATION = ["outs", "b1", "b2", "b3", "balls", "strikes"]


def requests_from_pitches(
    pitches: DataFrame, row_id: str, extra: tuple[str, ...] = ()
) -> DataFrame:
    """One request per recorded pitch: which pitch would have been best there?"""
    source = ["outs_when_up", "on_1b", "on_2b", "on_3b", "balls", "strikes"]
    return pitches.select(
        F.col(row_id).alias("request_id"), "pitcher", "batter",
        *[F.col(c).alias(name) for c, name in zip(source, SITUATION)], *extra,
    )


def spread(requests: DataFrame) -> DataFrame:
    """Distribute requests evenly before each becomes a hundred candidates.

    The rows are still narrow here, and picking the best candidate per request later
    needs no further shuffle.
    """
    partitions = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.repartition(partitions, "request_id")


def request_types(requests: DataFrame, arsenals: DataFrame) -> DataFrame:
    """One row per request and pitch type of the pitcher, with the hand and statistics.

    ``arsenals`` come from ``pitcher_arsenals``. A pitcher without one has nothing to
    choose from and drops out.
    """
    stats = [c for c in arsenals.columns if c.startswith(("avg", "sd"))]
    arsenal = arsenals.select("pitcher", TYPE, "p_throws", *stats)
    return null_safe_join(requests, arsenal, ["pitcher"]).withColumn(
        "state", state_key(*[F.col(c) for c in SITUATION])
    )


def draw_movement(rows: DataFrame, seed: int) -> DataFrame:
    """Draw the six movement metrics around the pitcher's means, once per request and type."""
    # One small expression over the six statistics: written out six times it is too long a method
    # for the JVM to compile. A draw reads its digest twice, so that is a column.
    names = F.array(*[F.lit(stat) for stat in K.MOVEMENT])
    digests = F.transform(names, lambda stat: draws.key_hash(seed, F.col("request_id"), F.col(TYPE), stat))
    rows = rows.withColumn("_digests", digests)
    rows = rows.withColumn("_normals", F.transform("_digests", draws.standard_normal))
    drawn = {
        metric: draws.around(F.col(f"avg{stat}"), F.col(f"sd{stat}"), F.get("_normals", F.lit(i)))
        for i, (stat, metric) in enumerate(K.MOVEMENT.items())
    }
    return rows.withColumns(drawn).drop("_digests", "_normals")


def hitter_features(
    rows: DataFrame, stands: DataFrame, hitters: DataFrame, generic: DataFrame
) -> DataFrame:
    """Add the batter's side and six statistics for each request and pitch type.

    The side is the one first stored against the hand (see ``first_stands``), or right.
    A stored profile is used whole; otherwise the generic one for that type, side and
    hand.
    """
    sided = null_safe_join(rows, stands, ["batter", "p_throws"], "left")
    sided = sided.withColumn("stand", F.coalesce("stand", F.lit("R")))

    keys = ["batter", TYPE, "p_throws", "stand"]
    own = hitters.select(
        *keys, F.lit(True).alias("_own"),
        *[F.col(c).alias(f"own_{c}") for c in K.HITTER_STATS],
    )
    found = null_safe_join(sided, own, keys, "left")

    keys = ["stand", TYPE, "p_throws"]
    common = generic.select(*keys, *[F.col(c).alias(f"any_{c}") for c in K.HITTER_STATS])
    found = null_safe_join(found, common, keys, "left")
    chosen = {
        c: F.when(F.col("_own"), F.col(f"own_{c}")).otherwise(F.col(f"any_{c}"))
        for c in K.HITTER_STATS
    }
    spare = [f"{side}_{c}" for side in ("own", "any") for c in K.HITTER_STATS]
    return found.withColumns(chosen).drop("_own", *spare)


def candidate_grid(rows: DataFrame) -> DataFrame:
    """Every allowed target of every request and pitch type.

    Targets are generated inside the row; ``x_idx`` and ``z_idx`` number them from 0.
    """
    across = rows.withColumn("_x", F.explode(geometry.horizontal_steps()))
    targets = across.withColumn("_z", F.explode(geometry.vertical_steps(F.col(TYPE))))
    x, z = F.col("_x"), F.col("_z")
    return targets.withColumns(
        {
            "x_idx": x + 2,
            "z_idx": z + 2,
            "plate_x": geometry.plate_x(x),
            "plate_z": geometry.plate_z(z, F.col("sz_bot"), F.col("sz_top")),
            "inZone": geometry.aimed_in_zone(x, z),
        }
    ).drop("_x", "_z")


def jitter_location(rows: DataFrame, seed: int, sd: float = K.MISS_SD) -> DataFrame:
    """Where the pitch ends up: the target with a normal miss on both axes."""
    missed = {}
    for axis in ("plate_x", "plate_z"):
        digest = draws.key_hash(seed, F.col("request_id"), F.lit(axis))
        missed[axis] = draws.normal(F.col(axis), F.lit(sd), digest)
    return rows.withColumns(missed)


def draw_outcome(
    rows: DataFrame, labels: list[str], seed: int, probs: str = "probs"
) -> DataFrame:
    """Draw one outcome per request from its probabilities, in label order."""
    u = draws.uniform(draws.key_hash(seed, F.col("request_id"), F.lit("outcome")))
    names = F.array(*[F.lit(label) for label in labels])
    return rows.withColumn("drawn_event", draws.weighted_choice(names, F.col(probs), u))
