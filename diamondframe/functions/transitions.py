"""What an outcome does to the outs, the bases and the count, as columns.

The bases are one small integer, first base in the lowest bit. A hit then is a shift:
the batter enters below first base and everybody moves left by the bases of the hit;
whatever passes third base has scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from diamondframe import constants as K
from diamondframe.functions.states import state_key


def occupancy(b1: Column, b2: Column, b3: Column) -> Column:
    return b1 + b2 * 2 + b3 * 4


def _moved(bases: Column, hit: int) -> Column:
    return F.shiftleft(bases * 2 + 1, hit)


def after_hit(bases: Column, hit: int) -> Column:
    """Occupancy after a hit of ``hit`` bases."""
    return F.shiftright(_moved(bases, hit).bitwiseAND(F.lit(14)), 1)


def runs_on_hit(bases: Column, hit: int) -> Column:
    """Runners, batter included, carried past third base."""
    return F.bit_count(F.shiftright(_moved(bases, hit), 4)).cast("int")


def after_force(bases: Column) -> Column:
    """Occupancy when the batter is awarded first base.

    With first and third taken, second and first are occupied afterwards and the
    runner on third is gone without a run: results depend on this rule.
    """
    first, second = bases.bitwiseAND(F.lit(1)), bases.bitwiseAND(F.lit(2))
    return F.when(first == 0, bases + 1).when(second == 0, F.lit(3)).otherwise(F.lit(7))


def runs_on_force(bases: Column) -> Column:
    """Only full bases push a run in."""
    return (bases == 7).cast("int")


def advance_slot(slot: Column, at_bat_over: Column, size: int = K.LINEUP_SIZE) -> Column:
    """Next batting-order slot once the at-bat is over."""
    return (slot + at_bat_over.cast("int")) % size


def apply_event(df: DataFrame, event: str = "events") -> DataFrame:
    """Add the state that follows ``event``.

    Reads ``outs, b1, b2, b3, balls, strikes``; adds ``next_outs, next_b1..3,
    next_balls, next_strikes, runs_scored, at_bat_over, next_state``. An outcome
    without a rule, or none, changes nothing.
    """
    happened = F.col(event)
    balls, strikes = F.col("balls"), F.col("strikes")
    bases = occupancy(F.col("b1"), F.col("b2"), F.col("b3"))

    def is_(name: str) -> Column:
        return F.coalesce(happened == name, F.lit(False))

    walked = is_("ball") & (balls >= 3)
    struck_out = is_("strike") & (strikes >= 2)
    forced = walked | is_("hit_by_pitch")
    out = struck_out | is_("out")
    hit = F.coalesce(happened.isin(list(K.BASES_PER_HIT)), F.lit(False))
    over = forced | out | hit
    strike_added = is_("strike") | (is_("foul") & (strikes < 2))

    next_bases, runs = F.when(forced, after_force(bases)), F.when(forced, runs_on_force(bases))
    for name, distance in K.BASES_PER_HIT.items():
        next_bases = next_bases.when(is_(name), after_hit(bases, distance))
        runs = runs.when(is_(name), runs_on_hit(bases, distance))

    moved = df.withColumns(
        {"_bases": next_bases.otherwise(bases), "runs_scored": runs.otherwise(F.lit(0))}
    )
    after = F.col("_bases")
    nxt = {
        "next_outs": F.col("outs") + out.cast("int"),
        "next_b1": after.bitwiseAND(F.lit(1)).cast("int"),
        "next_b2": F.shiftright(after.bitwiseAND(F.lit(2)), 1).cast("int"),
        "next_b3": F.shiftright(after.bitwiseAND(F.lit(4)), 2).cast("int"),
        "next_balls": F.when(over, 0).otherwise(balls + is_("ball").cast("int")),
        "next_strikes": F.when(over, 0).otherwise(strikes + strike_added.cast("int")),
        "at_bat_over": over,
    }
    keys = ["next_outs", "next_b1", "next_b2", "next_b3", "next_balls", "next_strikes"]
    return (
        moved.withColumns(nxt)
        .withColumn("next_state", state_key(*[F.col(k) for k in keys]))
        .drop("_bases")
    )
