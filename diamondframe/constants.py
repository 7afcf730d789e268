"""Values the results depend on, kept in one place."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# They must be exactly these for the results to be right.
# ---------------------------------------------------------------------------

NULL_TOKEN = "NULL"

PITCH_TYPES = ["CB", "CH", "CT", "FF", "SI", "SL", "KN"]

OUT_EVENTS = [
    "grounded_into_double_play", "force_out", "strikeout", "field_out", "sac_fly",
    "sac_bunt", "strikeout_double_play", "sac_fly_double_play", "other_out", "triple_play",
]

STRIKE_DESCRIPTIONS = [
    "called_strike", "swinging_strike", "swinging_strike_blocked", "foul_tip",
    "foul_bunt", "missed_bunt", "bunt_foul_tip",
]
BALL_DESCRIPTIONS = ["ball", "blocked_ball", "pitchout"]
FOUL_DESCRIPTIONS = ["foul"]

SWING_DESCRIPTIONS = [
    "hit_into_play", "foul", "swinging_strike", "swinging_strike_blocked", "foul_tip",
    "foul_bunt", "missed_bunt", "bunt_foul_tip",
]
IN_PLAY_DESCRIPTION = "hit_into_play"

# Outcomes kept for modelling; a missing outcome is kept as well.
KEPT_EVENTS = [
    "double", "hit_by_pitch", "home_run", "single", "triple", "walk", "out",
    "strike", "ball", "foul",
]

BASES_PER_HIT = {"single": 1, "double": 2, "triple": 3, "home_run": 4}

# Statistic name in the pitcher profile -> pitch metric it summarises.
MOVEMENT = {
    "Velo": "release_speed",
    "RPX": "release_pos_x",
    "RPZ": "release_pos_z",
    "RPY": "release_pos_y",
    "HBRK": "pfx_x",
    "VBRK": "pfx_z",
}

HITTER_STATS = ["avgEV", "avgLA", "zSwingPCT", "oSwingPCT", "sz_bot", "sz_top"]

# Order of the model's inputs.
FEATURES = [
    "release_speed", "release_pos_x", "release_pos_y", "release_pos_z", "pfx_x", "pfx_z",
    "plate_x", "plate_z", "sz_bot", "sz_top", "avgEV", "avgLA", "zSwingPCT", "oSwingPCT",
    "outs", "balls", "strikes", "stand_L", "stand_R", "p_throws_L", "p_throws_R",
]

INNING_START = "0_000_00"
INNING_OVER = "3_000_00"
OUTS_PER_INNING = 3
LINEUP_SIZE = 9

# Feet: the plate's half width as a pitcher sees it, and the usual miss.
PLATE_HALF_WIDTH = 9.97 / 12
MISS_SD = 0.4
HIGH_PITCH_TYPES = ["FF", "CT"]

GRID_MAX_DEPTH = [3, 5, 7]
GRID_LEARNING_RATE = [0.01, 0.05, 0.1]
GRID_ROUNDS = [50, 100, 200]
FOLDS = 5
FOLD_SEED = 42

# ---------------------------------------------------------------------------
# End of the fixed values.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class HitterThresholds:
    """A hitter's group is kept when every count is strictly above its threshold."""

    total_pitches: int = 500
    pitches: int = 50
    balls_in_play: int = 10


@dataclass(frozen=True)
class PitcherThresholds:
    """A pitcher's pitch type is kept when both values are strictly above."""

    total_pitches: int = 500
    usage: float = 0.03
