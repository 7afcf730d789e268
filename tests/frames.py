"""Hand-made pitches: a complete row with everything unremarkable, to be overridden."""

from __future__ import annotations

from diamondframe import schemas

PLAIN = dict(
    game_pk=1, inning=1, inning_topbot="Top", home_team="H", away_team="A",
    at_bat_number=1, pitch_number=1, outs_when_up=0, balls=0, strikes=0,
    on_1b=None, on_2b=None, on_3b=None, bat_score=0, post_bat_score=0,
    events=None, description="ball", pitcher=10, batter=20, p_throws="R", stand="R",
    pitch_type_condensed="FF", release_speed="95", release_pos_x="1", release_pos_y="50",
    release_pos_z="6", pfx_x="0.5", pfx_z="1", plate_x="0", plate_z="2.5",
    sz_bot="1.5", sz_top="3.5", zone="5", launch_speed=None, launch_angle=None,
)


def pitches(spark, *changes: dict):
    rows = [{**PLAIN, **change} for change in changes]
    names = schemas.PITCHES.names
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.PITCHES)


def collected(df, *key: str) -> list[dict]:
    found = [row.asDict(recursive=True) for row in df.collect()]
    return sorted(found, key=lambda r: tuple((r[k] is None, r[k] or 0) for k in key))
