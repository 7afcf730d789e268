"""The same results in plain SQL for DuckDB, over the ``events`` view."""

from __future__ import annotations

from pathlib import Path

_SOURCES = Path(__file__).resolve().parent / "diamondframe/sources"
_PITCHES = (_SOURCES / "pitches_from_events.sql").read_text()
_ODD_PITCHES = (_SOURCES / "odd_pitches.sql").read_text()

_CSV_NUMBERS = """at_bat_number pitch_number outs_when_up balls strikes bat_score post_bat_score
    pitcher batter""".split()
_CSV_TEXTS = """home_team away_team on_1b on_2b on_3b events p_throws stand release_speed
    release_pos_x release_pos_y release_pos_z pfx_x pfx_z plate_x plate_z sz_bot sz_top zone
    launch_speed launch_angle""".split()

# Common table expressions, in the order they depend on each other.
_CTES: dict[str, str] = {
    "pitches": _PITCHES,
    "rel": """
        SELECT event_id, game_pk, inning, inning_topbot, at_bat_number, pitch_number,
               outs_when_up AS outs,
               CASE WHEN NULLIF(on_1b, 'NULL') IS NULL THEN 0 ELSE 1 END AS b1,
               CASE WHEN NULLIF(on_2b, 'NULL') IS NULL THEN 0 ELSE 1 END AS b2,
               CASE WHEN NULLIF(on_3b, 'NULL') IS NULL THEN 0 ELSE 1 END AS b3,
               balls, strikes, bat_score, post_bat_score,
               CASE WHEN inning_topbot = 'Bot' THEN home_team ELSE away_team END AS bat_team,
               CASE WHEN events IN ('grounded_into_double_play', 'force_out', 'strikeout',
                                    'field_out', 'sac_fly', 'sac_bunt',
                                    'strikeout_double_play', 'sac_fly_double_play',
                                    'other_out', 'triple_play')
                    THEN 'out' ELSE NULLIF(events, 'NULL') END AS events,
               description, pitcher, p_throws, batter, stand,
               NULLIF(pitch_type_condensed, 'NULL') AS pitch_type_condensed,
               NULLIF(release_speed, 'NULL') AS release_speed_text,
               TRY_CAST(release_speed AS DOUBLE) AS release_speed,
               TRY_CAST(release_pos_x AS DOUBLE) AS release_pos_x,
               TRY_CAST(release_pos_y AS DOUBLE) AS release_pos_y,
               TRY_CAST(release_pos_z AS DOUBLE) AS release_pos_z,
               TRY_CAST(pfx_x AS DOUBLE) AS pfx_x, TRY_CAST(pfx_z AS DOUBLE) AS pfx_z,
               TRY_CAST(plate_x AS DOUBLE) AS plate_x, TRY_CAST(plate_z AS DOUBLE) AS plate_z,
               TRY_CAST(sz_bot AS DOUBLE) AS sz_bot, TRY_CAST(sz_top AS DOUBLE) AS sz_top,
               TRY_CAST(zone AS DOUBLE) AS zone,
               TRY_CAST(launch_speed AS DOUBLE) AS launch_speed,
               TRY_CAST(launch_angle AS DOUBLE) AS launch_angle,
               COALESCE(CAST(game_pk AS VARCHAR), 'NA') || '_' || inning || '_'
                   || inning_topbot AS game_inning
        FROM pitches WHERE inning < 10 AND balls < 4 AND strikes < 3""",
    "states": """
        SELECT *, outs || '_' || b1 || b2 || b3 || '_' || balls || strikes AS state,
               CASE WHEN zone < 10 THEN 1 WHEN zone >= 10 THEN 0 END AS in_zone,
               CASE WHEN description IN ('hit_into_play', 'foul', 'swinging_strike',
                         'swinging_strike_blocked', 'foul_tip', 'foul_bunt', 'missed_bunt',
                         'bunt_foul_tip') THEN 1 ELSE 0 END AS swing,
               CASE WHEN description IN ('called_strike', 'swinging_strike',
                         'swinging_strike_blocked', 'foul_tip', 'foul_bunt', 'missed_bunt',
                         'bunt_foul_tip') THEN 'strike'
                    WHEN description IN ('ball', 'blocked_ball', 'pitchout') THEN 'ball'
                    WHEN description = 'foul' THEN 'foul'
                    ELSE events END AS label
        FROM rel""",
    "labelled": """
        SELECT * FROM states
        WHERE label IS NULL OR label IN ('double', 'hit_by_pitch', 'home_run', 'single',
              'triple', 'walk', 'out', 'strike', 'ball', 'foul')""",
    "inning_max": """
        SELECT *, CASE WHEN COUNT(bat_score) OVER w = COUNT(*) OVER w
                       THEN MAX(bat_score) OVER w END AS post_inning_runs
        FROM states WINDOW w AS (PARTITION BY game_inning)""",
    "re": """
        SELECT state, CASE WHEN COUNT(post_inning_runs - bat_score) = COUNT(*)
                           THEN AVG(post_inning_runs - bat_score) END AS runs_expected,
               COUNT(*) AS occurrences
        FROM inning_max GROUP BY state""",
    "hitter_count": """
        SELECT batter, pitch_type_condensed, p_throws, stand, COUNT(*) AS pitches,
               MAX(total) AS total_pitches,
               CASE WHEN COUNT(description) = COUNT(*)
                    THEN COUNT(*) FILTER (description = 'hit_into_play') END AS bip
        FROM (SELECT *, COUNT(*) OVER (PARTITION BY batter) AS total FROM states)
        GROUP BY ALL""",
    "hitter_result": """
        SELECT batter, pitch_type_condensed, p_throws, stand,
               AVG(launch_speed) AS avgEV, AVG(launch_angle) AS avgLA,
               SUM(swing) FILTER (in_zone = 1) / NULLIF(COUNT(*) FILTER (in_zone = 1), 0)
                   AS zSwingPCT,
               SUM(swing) FILTER (in_zone = 0) / NULLIF(COUNT(*) FILTER (in_zone = 0), 0)
                   AS oSwingPCT,
               AVG(sz_bot) AS sz_bot, AVG(sz_top) AS sz_top
        FROM states
        WHERE pitch_type_condensed IN ('CB', 'CH', 'CT', 'FF', 'SI', 'SL', 'KN')
        GROUP BY ALL""",
    "hitters": """
        SELECT r.* FROM hitter_result r
        JOIN hitter_count c ON c.batter IS NOT DISTINCT FROM r.batter
         AND c.pitch_type_condensed = r.pitch_type_condensed
         AND c.p_throws = r.p_throws AND c.stand = r.stand
        WHERE c.total_pitches > 500 AND c.pitches > 50 AND c.bip > 10""",
    "generic": """
        SELECT stand, pitch_type_condensed, p_throws,
               AVG(launch_speed) AS avgEV, AVG(launch_angle) AS avgLA,
               SUM(swing) FILTER (in_zone = 1) / NULLIF(COUNT(*) FILTER (in_zone = 1), 0)
                   AS zSwingPCT,
               SUM(swing) FILTER (in_zone = 0) / NULLIF(COUNT(*) FILTER (in_zone = 0), 0)
                   AS oSwingPCT,
               AVG(sz_bot) AS sz_bot, AVG(sz_top) AS sz_top
        FROM states
        WHERE pitch_type_condensed IN ('CB', 'CH', 'CT', 'FF', 'SI', 'SL', 'KN')
        GROUP BY ALL""",
    "movement": """
        SELECT pitcher, pitch_type_condensed, p_throws,
               AVG(release_speed) AS avgVelo, AVG(release_pos_x) AS avgRPX,
               AVG(release_pos_z) AS avgRPZ, AVG(release_pos_y) AS avgRPY,
               AVG(pfx_x) AS avgHBRK, AVG(pfx_z) AS avgVBRK,
               STDDEV_SAMP(release_speed) AS sdVelo, STDDEV_SAMP(release_pos_x) AS sdRPX,
               STDDEV_SAMP(release_pos_z) AS sdRPZ, STDDEV_SAMP(release_pos_y) AS sdRPY,
               STDDEV_SAMP(pfx_x) AS sdHBRK, STDDEV_SAMP(pfx_z) AS sdVBRK
        FROM labelled
        WHERE pitch_type_condensed IN ('CB', 'CH', 'CT', 'FF', 'SI', 'SL', 'KN')
        GROUP BY ALL""",
    "usage": """
        SELECT pitcher, pitch_type_condensed, COUNT(*) AS pitches,
               MAX(total) AS total_pitches, COUNT(*) / MAX(total) AS usage_pct
        FROM (SELECT *, COUNT(*) OVER (PARTITION BY pitcher) AS total FROM states)
        GROUP BY pitcher, pitch_type_condensed
        HAVING MAX(total) > 500 AND COUNT(*) / MAX(total) > 0.03""",
    "pitchers": """
        SELECT m.*, u.pitches, u.total_pitches, u.usage_pct
        FROM usage u JOIN movement m ON m.pitcher IS NOT DISTINCT FROM u.pitcher
         AND m.pitch_type_condensed = u.pitch_type_condensed""",
    "training": """
        SELECT l.event_id, l.state, l.pitcher, l.p_throws, l.pitch_type_condensed,
               l.release_speed, l.release_pos_x, l.release_pos_z, l.release_pos_y,
               l.pfx_x, l.pfx_z, l.plate_x, l.plate_z, l.batter, l.stand,
               l.sz_bot, l.sz_top, l.label, l.outs, l.balls, l.strikes,
               h.stand AS prof_stand, h.sz_bot AS prof_sz_bot, h.sz_top AS prof_sz_top,
               CASE WHEN h.avgEV IS NOT NULL THEN h.avgEV ELSE g.avgEV END AS avgEV,
               CASE WHEN h.avgEV IS NOT NULL THEN h.avgLA ELSE g.avgLA END AS avgLA,
               CASE WHEN h.avgEV IS NOT NULL THEN h.zSwingPCT ELSE g.zSwingPCT END
                   AS zSwingPCT,
               CASE WHEN h.avgEV IS NOT NULL THEN h.oSwingPCT ELSE g.oSwingPCT END
                   AS oSwingPCT
        FROM labelled l
        LEFT JOIN hitters h
          ON l.batter IS NOT DISTINCT FROM h.batter
         AND l.p_throws IS NOT DISTINCT FROM h.p_throws
         AND l.pitch_type_condensed IS NOT DISTINCT FROM h.pitch_type_condensed
        LEFT JOIN generic g
          ON l.stand IS NOT DISTINCT FROM g.stand
         AND l.p_throws IS NOT DISTINCT FROM g.p_throws
         AND l.pitch_type_condensed IS NOT DISTINCT FROM g.pitch_type_condensed""",
    "complete": """
        SELECT * FROM training
        WHERE pitcher IS NOT NULL AND p_throws IS NOT NULL AND pitch_type_condensed IS NOT NULL
          AND release_speed IS NOT NULL AND release_pos_x IS NOT NULL
          AND release_pos_y IS NOT NULL AND release_pos_z IS NOT NULL
          AND pfx_x IS NOT NULL AND pfx_z IS NOT NULL
          AND plate_x IS NOT NULL AND plate_z IS NOT NULL
          AND batter IS NOT NULL AND stand IS NOT NULL
          AND sz_bot IS NOT NULL AND sz_top IS NOT NULL AND label IS NOT NULL
          AND avgEV IS NOT NULL AND avgLA IS NOT NULL
          AND zSwingPCT IS NOT NULL AND oSwingPCT IS NOT NULL""",
    "arsenal": """
        SELECT * FROM pitchers p
        WHERE p_throws = (SELECT q.p_throws FROM pitchers q
                          WHERE q.pitcher IS NOT DISTINCT FROM p.pitcher
                          ORDER BY q.pitch_type_condensed, q.p_throws LIMIT 1)""",
    "request_types": """
        SELECT r.event_id AS request_id, r.batter, r.outs, r.b1, r.b2, r.b3,
               r.balls, r.strikes, r.state, a.*
        FROM states r JOIN arsenal a ON a.pitcher IS NOT DISTINCT FROM r.pitcher""",
    "first_stand": """
        SELECT batter, p_throws, stand FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY batter, p_throws
                                         ORDER BY pitch_type_condensed, stand) AS n
            FROM hitters) WHERE n = 1""",
    "sided": """
        SELECT r.*, COALESCE(f.stand, 'R') AS stand FROM request_types r
        LEFT JOIN first_stand f ON f.batter IS NOT DISTINCT FROM r.batter
              AND f.p_throws = r.p_throws""",
    "profiled": """
        SELECT s.*,
               CASE WHEN h.batter IS NOT NULL THEN h.avgEV ELSE g.avgEV END AS avgEV,
               CASE WHEN h.batter IS NOT NULL THEN h.avgLA ELSE g.avgLA END AS avgLA,
               CASE WHEN h.batter IS NOT NULL THEN h.zSwingPCT ELSE g.zSwingPCT END
                   AS zSwingPCT,
               CASE WHEN h.batter IS NOT NULL THEN h.oSwingPCT ELSE g.oSwingPCT END
                   AS oSwingPCT,
               CASE WHEN h.batter IS NOT NULL THEN h.sz_bot ELSE g.sz_bot END AS sz_bot,
               CASE WHEN h.batter IS NOT NULL THEN h.sz_top ELSE g.sz_top END AS sz_top
        FROM sided s
        LEFT JOIN hitters h ON h.batter IS NOT DISTINCT FROM s.batter AND h.p_throws = s.p_throws
              AND h.stand = s.stand AND h.pitch_type_condensed = s.pitch_type_condensed
        LEFT JOIN generic g ON g.stand = s.stand AND g.p_throws = s.p_throws
              AND g.pitch_type_condensed = s.pitch_type_condensed""",
    "grid": """
        SELECT p.*, x.k + 2 AS x_idx, z.k + 2 AS z_idx,
               x.k * (2 * (9.97::DOUBLE / 12) / 3) AS plate_x,
               (p.sz_top + p.sz_bot) / 2 + z.k * (ABS(p.sz_top - p.sz_bot) / 3) AS plate_z,
               CASE WHEN ABS(x.k) <= 1 AND ABS(z.k) <= 1 THEN 1 ELSE 0 END AS in_zone
        FROM profiled p
        JOIN (VALUES (-2), (-1), (0), (1), (2)) x(k) ON TRUE
        JOIN (VALUES (-2), (-1), (0), (1), (2)) z(k)
          ON z.k <= 0 OR p.pitch_type_condensed IN ('FF', 'CT')""",
    "labels": """
        SELECT * FROM (VALUES (0, 'ball'), (1, 'double'), (2, 'foul'), (3, 'hit_by_pitch'),
            (4, 'home_run'), (5, 'out'), (6, 'single'), (7, 'strike'), (8, 'triple'),
            (9, 'walk')) v(code, label)""",
    # The bases after a hit or a forced advance, written out.
    "advances": """
        SELECT * FROM (VALUES
            ('force', '000', '100', 0), ('force', '100', '110', 0),
            ('force', '010', '110', 0), ('force', '001', '101', 0),
            ('force', '110', '111', 0), ('force', '101', '110', 0),
            ('force', '011', '111', 0), ('force', '111', '111', 1),
            ('single', '000', '100', 0), ('single', '100', '110', 0),
            ('single', '010', '101', 0), ('single', '001', '100', 1),
            ('single', '110', '111', 0), ('single', '101', '110', 1),
            ('single', '011', '101', 1), ('single', '111', '111', 1),
            ('double', '000', '010', 0), ('double', '100', '011', 0),
            ('double', '010', '010', 1), ('double', '001', '010', 1),
            ('double', '110', '011', 1), ('double', '101', '011', 1),
            ('double', '011', '010', 2), ('double', '111', '011', 2),
            ('triple', '000', '001', 0), ('triple', '100', '001', 1),
            ('triple', '010', '001', 1), ('triple', '001', '001', 1),
            ('triple', '110', '001', 2), ('triple', '101', '001', 2),
            ('triple', '011', '001', 2), ('triple', '111', '001', 3),
            ('home_run', '000', '000', 1), ('home_run', '100', '000', 2),
            ('home_run', '010', '000', 2), ('home_run', '001', '000', 2),
            ('home_run', '110', '000', 3), ('home_run', '101', '000', 3),
            ('home_run', '011', '000', 3), ('home_run', '111', '000', 4)
        ) v(move, bases, next_bases, runs)""",
    "situations": """
        SELECT DISTINCT state, outs, b1 || b2 || b3 AS bases, balls, strikes FROM states""",
    "moves": """
        SELECT s.*, l.label,
               CASE WHEN l.label = 'ball' AND s.balls = 3 THEN 'force'
                    WHEN l.label = 'hit_by_pitch' THEN 'force'
                    WHEN l.label IN ('single', 'double', 'triple', 'home_run') THEN l.label
                    WHEN l.label = 'out' OR (l.label = 'strike' AND s.strikes = 2) THEN 'out'
               END AS move
        FROM situations s
        JOIN (SELECT label FROM labels UNION ALL SELECT NULL) l ON TRUE""",
    "transitions": """
        SELECT m.state, m.label,
               CASE WHEN m.move IS NULL THEN 0 ELSE 1 END AS at_bat_over,
               m.outs + CASE WHEN m.move = 'out' THEN 1 ELSE 0 END AS next_outs,
               COALESCE(a.next_bases, m.bases) AS next_bases,
               COALESCE(a.runs, 0) AS runs_scored,
               CASE WHEN m.move IS NOT NULL THEN 0
                    WHEN m.label = 'ball' THEN m.balls + 1 ELSE m.balls END AS next_balls,
               CASE WHEN m.move IS NOT NULL THEN 0
                    WHEN m.label = 'strike' THEN m.strikes + 1
                    WHEN m.label = 'foul' AND m.strikes < 2 THEN m.strikes + 1
                    ELSE m.strikes END AS next_strikes
        FROM moves m LEFT JOIN advances a ON a.move = m.move AND a.bases = m.bases""",
    "next_states": """
        SELECT *, next_outs || '_' || next_bases || '_' || next_balls || next_strikes
               AS next_state FROM transitions""",
    "next_values": """
        SELECT n.state, n.label,
               CASE WHEN n.next_outs = 3 THEN 0.0::DOUBLE ELSE re.runs_expected END AS value
        FROM next_states n LEFT JOIN re ON re.state = n.next_state""",
    "cells": """
        SELECT pitch_type_condensed, balls, strikes, in_zone, COUNT(*) AS n
        FROM labelled WHERE label IS NOT NULL GROUP BY ALL""",
    "cell_labels": """
        SELECT pitch_type_condensed, balls, strikes, in_zone, label, COUNT(*) AS n
        FROM labelled WHERE label IS NOT NULL GROUP BY ALL""",
    "shares": """
        SELECT c.pitch_type_condensed, c.balls, c.strikes, c.in_zone, l.code, l.label,
               COALESCE(k.n, 0) / c.n AS p
        FROM cells c JOIN labels l ON TRUE
        LEFT JOIN cell_labels k
          ON k.pitch_type_condensed IS NOT DISTINCT FROM c.pitch_type_condensed
         AND k.balls = c.balls AND k.strikes = c.strikes
         AND k.in_zone IS NOT DISTINCT FROM c.in_zone AND k.label = l.label""",
    # One value per situation and cell: all candidates that share both have it.
    "cell_values": """
        SELECT v.state, s.pitch_type_condensed, s.in_zone,
               CASE WHEN COUNT(v.value) = 10 THEN SUM(s.p * v.value) END AS expected_runs
        FROM next_values v
        JOIN situations t ON t.state = v.state
        JOIN shares s ON s.label = v.label AND s.balls = t.balls AND s.strikes = t.strikes
        GROUP BY ALL""",
    "valued": """
        SELECT g.*, c.expected_runs FROM grid g
        LEFT JOIN cell_values c ON c.state = g.state AND c.in_zone = g.in_zone
              AND c.pitch_type_condensed = g.pitch_type_condensed""",
    "best": """
        SELECT * FROM (
            SELECT *, ROW_NUMBER() OVER (
                PARTITION BY request_id
                ORDER BY ROUND(expected_runs, 9), pitch_type_condensed, x_idx, z_idx) AS n
            FROM valued WHERE expected_runs IS NOT NULL) WHERE n = 1""",
    # Outcomes planted by count, and what a whole tree answers that has learned them.
    "count_values": """
        SELECT v.state, CASE WHEN COUNT(v.value) = 10 THEN
                   MAX(v.value) FILTER (l.code = (t.balls * 3 + t.strikes) % 10)
               END AS expected_runs
        FROM next_values v
        JOIN situations t ON t.state = v.state
        JOIN labels l ON l.label = v.label
        GROUP BY v.state""",
    "folded": """
        SELECT balls, strikes, label,
               (ROW_NUMBER() OVER (PARTITION BY label
                    ORDER BY MD5('42:' || event_id), event_id) - 1) % 5 AS fold
        FROM complete""",
    "fold_guesses": """
        SELECT * FROM (
            SELECT f.k AS fold, r.balls, r.strikes, r.label,
                   ROW_NUMBER() OVER (PARTITION BY f.k, r.balls, r.strikes
                                      ORDER BY COUNT(*) DESC, r.label) AS n
            FROM folded r JOIN (VALUES (0), (1), (2), (3), (4)) f(k) ON r.fold <> f.k
            GROUP BY f.k, r.balls, r.strikes, r.label) WHERE n = 1""",
    "fold_accuracy": """
        SELECT r.fold, AVG(CASE WHEN r.label = g.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                           AS accuracy
        FROM folded r
        JOIN fold_guesses g ON g.fold = r.fold AND g.balls = r.balls AND g.strikes = r.strikes
        GROUP BY r.fold""",
    "first_types": """
        SELECT request_id, MIN(pitch_type_condensed) AS pitch_type_condensed
        FROM request_types GROUP BY request_id""",
    "first_targets": """
        SELECT g.request_id, g.state, g.pitch_type_condensed, g.x_idx, g.z_idx, g.plate_x,
               g.plate_z
        FROM grid g
        JOIN first_types t ON t.request_id = g.request_id
         AND t.pitch_type_condensed = g.pitch_type_condensed
        WHERE g.x_idx = 0 AND g.z_idx = 0""",
    "tree_choices": """
        SELECT f.*, v.expected_runs FROM first_targets f
        JOIN count_values v ON v.state = f.state WHERE v.expected_runs IS NOT NULL""",
}

_OUTCOMES = """ball double foul hit_by_pitch home_run out single strike triple walk""".split()


def _rounded(*names: str) -> str:
    return ", ".join(f"ROUND({n}, 6) AS {n}" for n in names)


def _word(text: str, start: int) -> str:
    return f"CAST(CAST('0x' || SUBSTR(MD5({text}), {start}, 8) AS BIGINT) AS DOUBLE)"


def _normal(text: str) -> str:
    """Box-Muller on the first two words of a digest."""
    return (
        f"SQRT(-2 * LN(({_word(text, 1)} + 1) / 4294967297.0::DOUBLE))"
        f" * COS(2 * PI() * ({_word(text, 9)} / 4294967296.0::DOUBLE))"
    )


def _query(select: str, ctes: dict[str, str] = _CTES) -> str:
    """The select with the expressions it needs, and those they need."""
    needed: list[str] = []
    text = select
    for name in reversed(list(ctes)):
        words = text.replace("(", " ").replace(")", " ").replace(",", " ").split()
        sources = [b for a, b in zip(words, words[1:]) if a in ("FROM", "JOIN")]
        if name in sources:
            needed.append(name)
            text += "\n" + ctes[name]
    body = ",\n".join(f"{n} AS MATERIALIZED (\n{ctes[n]}\n)" for n in reversed(needed))
    return f"WITH {body}\n{select}"


_STATS = ["avgEV", "avgLA", "zSwingPCT", "oSwingPCT", "sz_bot", "sz_top"]
_MOVES = {
    "release_speed": "Velo", "release_pos_x": "RPX", "release_pos_z": "RPZ",
    "release_pos_y": "RPY", "pfx_x": "HBRK", "pfx_z": "VBRK",
}
_MOVEMENT = [f"avg{s}" for s in _MOVES.values()] + [f"sd{s}" for s in _MOVES.values()]
_METRICS = ["release_speed", "release_pos_x", "release_pos_z", "release_pos_y",
            "pfx_x", "pfx_z", "plate_x", "plate_z", "sz_bot", "sz_top"]
_SHARED = ["avgEV", "avgLA", "zSwingPCT", "oSwingPCT"]
_TRAINING = ("event_id, state AS out_base_count_state, pitcher, p_throws, "
             "pitch_type_condensed, batter, stand, label AS events")

_SELECTS: dict[str, str] = {
    "pitch_states": """
        SELECT event_id, bat_team, state AS out_base_count_state,
               CAST(b1 AS BIGINT) AS on_1b, CAST(b2 AS BIGINT) AS on_2b,
               CAST(b3 AS BIGINT) AS on_3b, at_bat_number + 1 AS next_at_bat_number,
               game_inning, game_inning || '_' || at_bat_number AS game_inning_ab,
               game_inning || '_' || at_bat_number || '_' || pitch_number
                   AS game_inning_ab_pitch,
               game_inning || '_' || (at_bat_number + 1) AS next_game_inning_ab
        FROM states""",
    "outcome_labels": "SELECT event_id, label AS events FROM labelled",
    "inning_runs": """
        SELECT event_id, game_inning, post_inning_runs,
               post_inning_runs - bat_score AS runs_post_ab,
               post_bat_score - bat_score AS runs_from_event
        FROM inning_max""",
    "run_expectancy": f"""
        SELECT state AS out_base_count_state, {_rounded("runs_expected")}, occurrences
        FROM re""",
    "run_values": f"""
        SELECT event_id, game_pk, at_bat_number, pitch_number,
               state AS out_base_count_state, next_out_base_count_state, runs_from_event,
               ROUND(runs_expected, 6) AS runs_expected,
               ROUND(next_re, 6) AS next_runs_expected,
               ROUND(next_re - runs_expected + runs_from_event, 6) AS delta_re
        FROM (SELECT *, CASE WHEN next_out_base_count_state = '0_000_00' THEN 0
                             ELSE following END AS next_re
              FROM (SELECT r.*, re.runs_expected,
                           post_bat_score - bat_score AS runs_from_event,
                           LEAD(r.state) OVER w AS next_out_base_count_state,
                           LEAD(re.runs_expected) OVER w AS following
                    FROM states r JOIN re ON re.state = r.state
                    WINDOW w AS (ORDER BY game_pk NULLS LAST, at_bat_number NULLS LAST,
                                          pitch_number NULLS LAST, r.state,
                                          bat_score NULLS LAST, post_bat_score NULLS LAST,
                                          batter NULLS LAST, pitcher NULLS LAST)))""",
    "inning_trajectory": """
        SELECT game_inning, ROW_NUMBER() OVER (PARTITION BY game_inning
                                ORDER BY at_bat_number, pitch_number, r.state,
                                         bat_score NULLS LAST) AS pitch_index,
               r.state,
               ROUND(re.runs_expected + bat_score
                     - CASE WHEN COUNT(bat_score) OVER i = COUNT(*) OVER i
                            THEN MIN(bat_score) OVER i END, 6) AS expected_total
        FROM states r JOIN re ON re.state = r.state
        WINDOW i AS (PARTITION BY game_inning)
        UNION ALL
        SELECT game_inning, COUNT(*) + 1, '3_000_00',
               ROUND(CAST(CASE WHEN COUNT(bat_score) = COUNT(*)
                                AND COUNT(post_bat_score) = COUNT(*)
                               THEN MAX(post_bat_score) - MIN(bat_score) END AS DOUBLE), 6)
        FROM states GROUP BY game_inning""",
    "batting_slots": """
        SELECT game_pk, inning_topbot, at_bat_number, (n - 1) % 9 AS slot, n % 9 AS next_slot
        FROM (SELECT game_pk, inning_topbot, at_bat_number,
                     ROW_NUMBER() OVER (PARTITION BY game_pk, inning_topbot
                                        ORDER BY at_bat_number) AS n
              FROM (SELECT DISTINCT game_pk, inning_topbot, at_bat_number FROM states))""",
    "swing_zone_flags": """
        SELECT event_id, launch_speed, launch_angle, sz_bot, sz_top, zone,
               CAST(in_zone AS BIGINT) AS inZone, CAST(swing AS BIGINT) AS swing
        FROM states""",
    "hitter_counts": """
        SELECT batter, pitch_type_condensed, p_throws, stand, pitches,
               total_pitches AS totalPitches, bip AS BIP
        FROM hitter_count""",
    "hitter_profiles": f"""
        SELECT batter, pitch_type_condensed, p_throws, stand, {_rounded(*_STATS)}
        FROM hitters""",
    "generic_hitter_profiles": f"""
        SELECT stand, pitch_type_condensed, p_throws, {_rounded(*_STATS)} FROM generic""",
    "pitcher_movement": f"""
        SELECT pitcher, pitch_type_condensed, p_throws, {_rounded(*_MOVEMENT)}
        FROM movement""",
    "pitcher_usage": """
        SELECT pitcher, pitch_type_condensed, pitches, total_pitches AS totalPitches,
               ROUND(usage_pct, 6) AS usagePCT
        FROM usage""",
    "pitcher_profiles": f"""
        SELECT pitcher, pitch_type_condensed, p_throws, pitches,
               total_pitches AS totalPitches, ROUND(usage_pct, 6) AS usagePCT,
               {_rounded(*_MOVEMENT)}
        FROM pitchers""",
    "training_table": f"""
        SELECT {_TRAINING}, prof_stand,
               {_rounded(*_METRICS, "prof_sz_bot", "prof_sz_top", *_SHARED)}
        FROM training""",
    "complete_rows": f"""
        SELECT {_TRAINING}, {_rounded(*_METRICS, *_SHARED)} FROM complete""",
    "filled_and_unfilled": """
        SELECT event_id, prof_stand, ROUND(avgEV, 6) AS avgEV,
               ROUND(prof_sz_bot, 6) AS prof_sz_bot
        FROM training""",
    "model_features": f"""
        SELECT event_id, label AS events, DENSE_RANK() OVER (ORDER BY label) - 1 AS label,
               CAST(outs AS BIGINT) AS outs, CAST(balls AS BIGINT) AS balls,
               CAST(strikes AS BIGINT) AS strikes,
               CAST(stand = 'L' AS BIGINT) AS stand_L, CAST(stand = 'R' AS BIGINT) AS stand_R,
               CAST(p_throws = 'L' AS BIGINT) AS p_throws_L,
               CAST(p_throws = 'R' AS BIGINT) AS p_throws_R,
               {_rounded(*_METRICS, *_SHARED)}
        FROM complete""",
    "keyed_lookup": """
        SELECT pitcher, p_throws, pitch_type_condensed, event_id,
               release_speed_text AS release_speed, description
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pitcher, p_throws,
                            pitch_type_condensed ORDER BY event_id DESC) AS n FROM states)
        WHERE n = 1""",
    "profile_map": f"""
        SELECT pitcher, p_throws, pitch_type_condensed, {_rounded("avgVelo", "sdVelo")}
        FROM pitchers""",
    "pitcher_arsenals": f"""
        SELECT pitcher, p_throws, pitch_type_condensed, {_rounded("avgVelo", "sdVelo")}
        FROM arsenal""",
    "sampled_keys": """
        SELECT game_pk FROM (SELECT DISTINCT game_pk FROM states)
        ORDER BY MD5('7:' || game_pk), game_pk LIMIT 9""",
    "distinct_keys": "SELECT DISTINCT pitcher, pitch_type_condensed FROM states",
    "transition_table": """
        SELECT n.state, n.label AS events, o.occurrences, n.next_state,
               CAST(n.next_outs AS BIGINT) AS next_outs,
               CAST(n.runs_scored AS BIGINT) AS runs_scored,
               CAST(n.at_bat_over AS BIGINT) AS at_bat_over
        FROM next_states n
        JOIN (SELECT state, label, COUNT(*) AS occurrences FROM labelled GROUP BY ALL) o
          ON o.state = n.state AND o.label IS NOT DISTINCT FROM n.label""",
    "hitter_features": f"""
        SELECT request_id, batter, p_throws, pitch_type_condensed, stand, {_rounded(*_STATS)}
        FROM profiled""",
    "candidate_grid": f"""
        SELECT request_id, pitcher, pitch_type_condensed, CAST(x_idx AS BIGINT) AS x_idx,
               CAST(z_idx AS BIGINT) AS z_idx, CAST(in_zone AS BIGINT) AS inZone,
               {_rounded("plate_x", "plate_z")}
        FROM grid""",
    "expected_runs": f"""
        SELECT request_id, pitch_type_condensed, CAST(x_idx AS BIGINT) AS x_idx,
               CAST(z_idx AS BIGINT) AS z_idx, {_rounded("expected_runs")}
        FROM valued""",
    "best_pitch": f"""
        SELECT request_id, pitch_type_condensed, CAST(x_idx AS BIGINT) AS x_idx,
               CAST(z_idx AS BIGINT) AS z_idx,
               {_rounded("plate_x", "plate_z", "expected_runs")}
        FROM best""",
    "location_jitter": f"""
        SELECT request_id,
               ROUND(plate_x + 0.4::DOUBLE * {_normal("'7:' || request_id || ':plate_x'")}, 6)
                   AS plate_x,
               ROUND(plate_z + 0.4::DOUBLE * {_normal("'7:' || request_id || ':plate_z'")}, 6)
                   AS plate_z
        FROM best""",
    "movement_draws": "SELECT request_id, pitch_type_condensed, "
    + ", ".join(
        f"ROUND(CASE WHEN sd{s} IS NULL THEN avg{s} ELSE avg{s} + sd{s} * "
        + _normal(f"'7:' || request_id || ':' || pitch_type_condensed || ':{s}'")
        + f" END, 6) AS {m}"
        for m, s in _MOVES.items()
    )
    + " FROM request_types",
    "outcome_draws": f"""
        SELECT d.request_id, l.label AS drawn_event
        FROM (SELECT r.event_id AS request_id,
                     LEAST(COUNT(*) FILTER (c.upto <= r.u * c.total), 9) AS code
              FROM (SELECT *, {_word("'7:' || event_id || ':outcome'", 1)}
                              / 4294967296.0::DOUBLE AS u FROM labelled) r
              JOIN (SELECT *,
                           SUM(p) OVER (PARTITION BY pitch_type_condensed, balls, strikes,
                                        in_zone ORDER BY code) AS upto,
                           SUM(p) OVER (PARTITION BY pitch_type_condensed, balls, strikes,
                                        in_zone) AS total
                    FROM shares) c
                ON c.pitch_type_condensed IS NOT DISTINCT FROM r.pitch_type_condensed
               AND c.balls = r.balls AND c.strikes = r.strikes
               AND c.in_zone IS NOT DISTINCT FROM r.in_zone
              GROUP BY r.event_id) d
        JOIN labels l ON l.code = d.code""",
    "pitch_outcomes": f"""
        SELECT d.request_id, d.pitch_type_condensed, d.state, l.label AS drawn_event,
               n.next_state, CAST(n.next_outs AS BIGINT) AS next_outs,
               CAST(n.runs_scored AS BIGINT) AS runs_scored,
               CAST(n.at_bat_over AS BIGINT) AS at_bat_over
        FROM (SELECT b.request_id, b.pitch_type_condensed, b.state,
                     LEAST(COUNT(*) FILTER (c.upto <= b.u * c.total), 9) AS code
              FROM (SELECT *, {_word("'7:' || request_id || ':outcome'", 1)}
                              / 4294967296.0::DOUBLE AS u FROM best) b
              JOIN (SELECT *,
                           SUM(p) OVER (PARTITION BY pitch_type_condensed, balls, strikes,
                                        in_zone ORDER BY code) AS upto,
                           SUM(p) OVER (PARTITION BY pitch_type_condensed, balls, strikes,
                                        in_zone) AS total
                    FROM shares) c
                ON c.pitch_type_condensed = b.pitch_type_condensed
               AND c.balls = b.balls AND c.strikes = b.strikes AND c.in_zone = b.in_zone
              GROUP BY b.request_id, b.pitch_type_condensed, b.state) d
        JOIN labels l ON l.code = d.code
        JOIN next_states n ON n.state = d.state AND n.label = l.label""",
    "stratified_folds": """
        SELECT event_id, label AS events,
               (ROW_NUMBER() OVER (PARTITION BY label
                    ORDER BY MD5('42:' || event_id), event_id) - 1) % 5 AS fold
        FROM labelled WHERE label IS NOT NULL""",
    "csv_pitches": f"""
        SELECT game_pk, inning, inning_topbot,
               NULLIF(pitch_type_condensed, 'NULL') AS pitch_type_condensed, description,
               COUNT(*) AS pitches, COUNT(NULLIF(events, 'NULL')) AS with_event,
               {", ".join(f"CAST(SUM({c}) AS BIGINT) AS sum_{c}" for c in _CSV_NUMBERS)},
               {", ".join(f"MIN(NULLIF({c}, 'NULL')) AS min_{c}" for c in _CSV_TEXTS)}
        FROM pitches GROUP BY ALL""",
    "table_round_trip": """
        SELECT state AS out_base_count_state, ROUND(runs_expected, 6) AS runs_expected,
               ROUND(runs_expected, 6) AS parquet_runs_expected, occurrences
        FROM re""",
}

_SELECTS |= {
    "tree_scores": f"""
        SELECT event_id, {", ".join(
            f"CASE WHEN (balls * 3 + strikes) % 10 = {n} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
            f" AS p_{x}" for n, x in enumerate(_OUTCOMES))}
        FROM complete""",
    "tree_cv": """
        SELECT CAST(p.i AS INTEGER) AS param_idx, p.params,
               ROUND(a.mean, 6) AS average_test_accuracy, p.i = 0 AS best
        FROM (SELECT AVG(accuracy) AS mean FROM fold_accuracy) a
        JOIN (VALUES (0, 'maxDepth=10'), (1, 'maxDepth=12')) p(i, params) ON TRUE""",
    "tree_recommend": f"""
        SELECT s.event_id AS request_id, c.pitch_type_condensed,
               CAST(c.x_idx AS BIGINT) AS x_idx, CAST(c.z_idx AS BIGINT) AS z_idx,
               {_rounded("c.plate_x", "c.plate_z", "c.expected_runs").replace("AS c.", "AS ")},
               CASE WHEN c.request_id IS NOT NULL THEN NULL
                    WHEN s.pitcher IN (SELECT pitcher FROM arsenal)
                    THEN 'no candidate has a value'
                    ELSE 'the pitcher has no arsenal' END AS reason
        FROM states s LEFT JOIN tree_choices c ON c.request_id = s.event_id""",
}
# Tables that went through files; they hold what the queries of their making hold.
_SELECTS |= {
    "hitters_read_back": _SELECTS["hitter_profiles"],
    "generic_hitters_read_back": _SELECTS["generic_hitter_profiles"],
    "pitchers_read_back": _SELECTS["pitcher_profiles"],
    "training_read_back": f"""
        SELECT {_TRAINING.removeprefix("event_id, ")}, {_rounded(*_METRICS, *_SHARED)}
        FROM complete""",
}

# The model's inputs in their order; the query's columns are numbered.
_INPUTS = """release_speed release_pos_x release_pos_y release_pos_z pfx_x pfx_z plate_x plate_z
    sz_bot sz_top avgEV avgLA zSwingPCT oSwingPCT outs balls strikes""".split()
_SIDES = {"stand_L": "stand = 'L'", "stand_R": "stand = 'R'",
          "p_throws_L": "p_throws = 'L'", "p_throws_R": "p_throws = 'R'"}
_REQUIRED = """pitcher p_throws pitch_type_condensed release_speed release_pos_x release_pos_z
    release_pos_y pfx_x pfx_z plate_x plate_z batter stand sz_bot sz_top""".split()
_SELECTS |= {
    "feature_vectors": "SELECT event_id, " + ", ".join(
        f"ROUND(CAST({c} AS DOUBLE), 6) AS v{i:02d}"
        for i, c in enumerate([*_INPUTS, *_SIDES.values()])
    ) + " FROM complete",
    "missing_values": " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS missing, "
        "(SELECT COUNT(*) FROM complete) AS kept, COUNT(*) AS rows FROM training"
        for name, c in [("out_base_count_state", "state"), *[(c, c) for c in _REQUIRED],
                        ("events", "label"), *[(c, c) for c in _SHARED]]
    ),
    # Pure leaves: every round adds the same step to the margin of an outcome's own rows, and
    # takes it from all others; ten such answers are scaled to one.
    "boosted_scores": f"""
        SELECT event_id, {", ".join(
            f"ROUND(CASE WHEN (balls * 3 + strikes) % 10 = {n} THEN yes ELSE 1 - yes END"
            f" / (yes + 9 * (1 - yes)), 6) AS p_{x}" for n, x in enumerate(_OUTCOMES))}
        FROM complete, (
            SELECT 1 / (1 + EXP(-2 * list_reduce([1.0::DOUBLE, 2, 3, 4, 5], lambda f, k:
                       f + 0.1::DOUBLE * 4 / (1 + EXP(2 * f))))) AS yes)""",
}

# What the input trees split at; a request's inputs as in the candidates, movement as drawn.
_SPLITS = {
    "release_speed": 89.7, "release_pos_x": 0.1, "release_pos_y": 52.4, "release_pos_z": 5.4,
    "pfx_x": 0.1, "pfx_z": 0.4, "plate_x": 0.3, "plate_z": 2.1, "sz_bot": 1.503,
    "sz_top": 3.503, "avgEV": 84.3, "avgLA": 9.3, "zSwingPCT": 0.431, "oSwingPCT": 0.432,
    "outs": 0.5, "balls": 1.5, "strikes": 0.5,
}
_SELECTS["input_splits"] = (
    "SELECT request_id, pitch_type_condensed, "
    + ", ".join(
        f"COUNT(*) FILTER (({c} <= {at}) IS NOT TRUE) AS above_{c}" for c, at in _SPLITS.items()
    )
    + ", "
    + ", ".join(f"COUNT(*) FILTER ({test}) AS above_{c}" for c, test in _SIDES.items())
    + " FROM (SELECT *, "
    + ", ".join(
        f"CASE WHEN sd{s} IS NULL THEN avg{s} ELSE avg{s} + sd{s} * "
        + _normal(f"'7:' || request_id || ':' || pitch_type_condensed || ':{s}'") + f" END AS {m}"
        for m, s in _MOVES.items()
    )
    + " FROM grid) GROUP BY request_id, pitch_type_condensed"
)

ORACLES: dict[str, str] = {name: _query(select) for name, select in _SELECTS.items()}

# The same queries over pitches with switch hitters, missing values and doubled keys.
_ODD_CTES = {"clean_pitches": _PITCHES} | _CTES | {
    "pitches": _ODD_PITCHES.replace("FROM pitches", "FROM clean_pitches")
}
_ODD = """pitch_states inning_runs run_expectancy run_values inning_trajectory batting_slots
    hitter_counts hitter_profiles generic_hitter_profiles pitcher_usage pitcher_profiles
    training_table complete_rows missing_values keyed_lookup profile_map pitcher_arsenals
    hitter_features best_pitch""".split()
ORACLES |= {f"odd_{name}": _query(_SELECTS[name], _ODD_CTES) for name in _ODD}
