"""Game-state columns: runner flags, state keys and their parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from diamondframe.functions.missing import joined_key, part


def bat_team(half: Column, home: Column, away: Column) -> Column:
    """The home team bats in the bottom half; unknown half, unknown team."""
    return F.when(half.isNotNull(), F.when(half == "Bot", home).otherwise(away))


def runner_flag(runner: Column) -> Column:
    """1 when a runner is named on the base, else 0."""
    return runner.isNotNull().cast("int")


def state_key(
    outs: Column, b1: Column, b2: Column, b3: Column, balls: Column, strikes: Column
) -> Column:
    """``outs_bases_count``, e.g. ``1_101_32``."""
    bases = F.concat(part(b1), part(b2), part(b3))
    return F.concat_ws("_", part(outs), bases, F.concat(part(balls), part(strikes)))


def parse_state(key: Column) -> dict[str, Column]:
    """Outs, runner flags, balls and strikes back out of a state key."""
    pieces = F.split(key, "_")
    bases, pitch_count = F.get(pieces, F.lit(1)), F.get(pieces, F.lit(2))
    return {
        "outs": F.get(pieces, F.lit(0)).try_cast("int"),
        "b1": F.substring(bases, 1, 1).try_cast("int"),
        "b2": F.substring(bases, 2, 1).try_cast("int"),
        "b3": F.substring(bases, 3, 1).try_cast("int"),
        "balls": F.substring(pitch_count, 1, 1).try_cast("int"),
        "strikes": F.substring(pitch_count, 2, 1).try_cast("int"),
    }


def inning_keys() -> dict[str, Column]:
    """Keys of the half-inning, the at-bat, the pitch, and the at-bat that follows."""
    half = [F.col("game_pk"), F.col("inning"), F.col("inning_topbot")]
    at_bat = F.col("at_bat_number")
    return {
        "game_inning": joined_key(*half),
        "game_inning_ab": joined_key(*half, at_bat),
        "game_inning_ab_pitch": joined_key(*half, at_bat, F.col("pitch_number")),
        "next_at_bat_number": at_bat + 1,
        "next_game_inning_ab": joined_key(*half, at_bat + 1),
    }
