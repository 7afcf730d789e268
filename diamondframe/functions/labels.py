"""Outcome labels and per-pitch indicator columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from diamondframe import constants as K


def recode_outs(events: Column) -> Column:
    """Every way of making an out becomes ``out``."""
    return F.when(events.isin(K.OUT_EVENTS), F.lit("out")).otherwise(events)


def outcome_class(events: Column, description: Column) -> Column:
    """The pitch's description overrides the event for strikes, balls and fouls.

    The description lists are disjoint, so their order does not matter; a third
    strike is therefore a ``strike`` and a fourth ball a ``ball``.
    """
    return (
        F.when(description.isin(K.STRIKE_DESCRIPTIONS), F.lit("strike"))
        .when(description.isin(K.BALL_DESCRIPTIONS), F.lit("ball"))
        .when(description.isin(K.FOUL_DESCRIPTIONS), F.lit("foul"))
        .otherwise(events)
    )


def kept_outcome(events: Column) -> Column:
    """True for the modelled outcomes and for a missing one, which passes as an out."""
    return F.coalesce(events, F.lit("out")).isin(K.KEPT_EVENTS)


def in_zone(zone: Column) -> Column:
    """1 inside the strike zone, 0 outside, null when the zone is unknown."""
    return (zone < 10).cast("int")


def swing(description: Column) -> Column:
    """1 when the batter swung; an unknown description is no swing."""
    return F.coalesce(description.isin(K.SWING_DESCRIPTIONS), F.lit(False)).cast("int")


def known_pitch_type(pitch_type: Column) -> Column:
    return pitch_type.isin(K.PITCH_TYPES)


def side_flags(stand: Column, throws: Column, right_only: bool = False) -> dict[str, Column]:
    """One-hot columns for the batter's and the pitcher's side.

    ``right_only`` marks every pitcher as right-handed, which is how scores were
    computed historically; by default the hand is encoded as it was in training.
    """
    def flag(column: Column, side: str) -> Column:
        return F.when(column == side, 1).otherwise(0)

    return {
        "stand_L": flag(stand, "L"),
        "stand_R": flag(stand, "R"),
        "p_throws_L": F.lit(0) if right_only else flag(throws, "L"),
        "p_throws_R": F.lit(1) if right_only else flag(throws, "R"),
    }
