"""Explicit schemas: nothing is inferred from the files."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: str) -> T.StructType:
    kinds = {"long": T.LongType(), "text": T.StringType(), "double": T.DoubleType()}
    fields = []
    for kind, names in columns.items():
        fields += [T.StructField(name, kinds[kind]) for name in names.split()]
    return T.StructType(fields)


def _ordered(schema: T.StructType, names: list[str]) -> T.StructType:
    return T.StructType([schema[name] for name in names])


# The metrics arrive as text because a missing value is the word NULL.
PITCHES = _schema(
    long="""game_pk inning at_bat_number pitch_number outs_when_up balls strikes
            bat_score post_bat_score pitcher batter""",
    text="""inning_topbot home_team away_team on_1b on_2b on_3b events description
            p_throws stand pitch_type_condensed
            release_speed release_pos_x release_pos_y release_pos_z pfx_x pfx_z
            plate_x plate_z sz_bot sz_top zone launch_speed launch_angle""",
)

_MOVEMENT_STATS = (
    "avgVelo avgRPX avgRPZ avgRPY avgHBRK avgVBRK sdVelo sdRPX sdRPZ sdRPY sdHBRK sdVBRK"
)

TABLES = {
    "re288": _ordered(
        _schema(text="out_base_count_state", double="runs_expected", long="occurrences"),
        ["out_base_count_state", "runs_expected", "occurrences"],
    ),
    "ind_hitter_sum": _ordered(
        _schema(
            long="batter",
            text="pitch_type_condensed p_throws stand",
            double="avgEV avgLA zSwingPCT oSwingPCT sz_bot sz_top",
        ),
        """batter pitch_type_condensed p_throws stand
           avgEV avgLA zSwingPCT oSwingPCT sz_bot sz_top""".split(),
    ),
    "generic_hitter_sum": _schema(
        text="stand pitch_type_condensed p_throws",
        double="avgEV avgLA zSwingPCT oSwingPCT sz_bot sz_top",
    ),
    "ind_pitcher_sum": _ordered(
        _schema(
            long="pitcher pitches totalPitches",
            text="pitch_type_condensed p_throws",
            double="usagePCT " + _MOVEMENT_STATS,
        ),
        ("pitcher pitch_type_condensed pitches totalPitches usagePCT p_throws "
         + _MOVEMENT_STATS).split(),
    ),
    "model_data": _ordered(
        _schema(
            long="pitcher batter",
            text="out_base_count_state p_throws pitch_type_condensed stand events prof_stand",
            double="""release_speed release_pos_x release_pos_z release_pos_y pfx_x pfx_z
                      plate_x plate_z sz_bot sz_top prof_sz_bot prof_sz_top
                      avgEV avgLA zSwingPCT oSwingPCT""",
        ),
        """out_base_count_state pitcher p_throws pitch_type_condensed
           release_speed release_pos_x release_pos_z release_pos_y pfx_x pfx_z
           plate_x plate_z batter stand sz_bot sz_top events
           prof_stand prof_sz_bot prof_sz_top
           avgEV avgLA zSwingPCT oSwingPCT""".split(),
    ),
}
