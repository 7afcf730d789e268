"""Where a pitch may be aimed: a grid of thirds around the middle of the zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from diamondframe import constants as K

PLATE_THIRD = 2 * K.PLATE_HALF_WIDTH / 3


def horizontal_steps() -> Column:
    """Two thirds of the plate to either side of its middle."""
    return F.sequence(F.lit(-2), F.lit(2))


def vertical_steps(pitch_type: Column) -> Column:
    """Only some pitch types may be aimed above the middle of the zone."""
    highest = F.when(pitch_type.isin(K.HIGH_PITCH_TYPES), 2).otherwise(0)
    return F.sequence(F.lit(-2), highest)


def plate_x(step: Column) -> Column:
    return step * F.lit(PLATE_THIRD)


def plate_z(step: Column, bottom: Column, top: Column) -> Column:
    return (top + bottom) / 2 + step * (F.abs(top - bottom) / 3)


def aimed_in_zone(x_step: Column, z_step: Column) -> Column:
    """1 for a target within the zone: at most one third from its middle."""
    return ((F.abs(x_step) <= 1) & (F.abs(z_step) <= 1)).cast("int")
