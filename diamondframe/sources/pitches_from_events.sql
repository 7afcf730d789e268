WITH b AS (
  SELECT event_id, user_id,
         CAST(ROUND(value * 100) AS BIGINT) * 7919 + event_id * 104729 AS h,
         event_id % 300 AS g,
         CAST(FLOOR(event_id / 300.0) AS BIGINT) AS game
  FROM events
), d AS (
  SELECT event_id, user_id, g, game, h,
         h % 100 AS r1,
         CAST(FLOOR(h / 100.0) AS BIGINT) % 100 AS r2,
         CAST(FLOOR(h / 10000.0) AS BIGINT) % 100 AS r3,
         CAST(FLOOR(h / 1000000.0) AS BIGINT) % 60 AS r4,
         g % 5 + 1 AS pitch_number,
         CAST(FLOOR(g / 5.0) AS BIGINT) + 1 AS at_bat_number,
         CAST(FLOOR((g % 15) / 5.0) AS BIGINT) AS outs_when_up,
         user_id % 10 AS pitcher,
         1000 + CAST(FLOOR(h / 7.0) AS BIGINT) % 8 AS batter
  FROM b
), k AS (
  SELECT d.*,
         CASE WHEN pitcher % 3 = 0 THEN 'L' ELSE 'R' END AS p_throws,
         CASE WHEN pitch_number = 1 THEN 0 ELSE r4 % 5 END AS balls,
         CASE WHEN pitch_number = 1 THEN 0 ELSE CAST(FLOOR(r4 / 5.0) AS BIGINT) % 4 END AS strikes,
         CASE WHEN r1 < 30 THEN 'ball' WHEN r1 < 42 THEN 'called_strike'
              WHEN r1 < 52 THEN 'swinging_strike' WHEN r1 < 67 THEN 'foul'
              WHEN r1 < 68 THEN 'foul_tip' WHEN r1 < 69 THEN 'blocked_ball'
              WHEN r1 < 71 THEN 'hit_by_pitch' WHEN r1 < 73 THEN 'automatic_ball'
              ELSE 'hit_into_play' END AS description
  FROM d
)
SELECT event_id,
       700000 + game AS game_pk,
       CAST(FLOOR(g / 30.0) AS BIGINT) + 1 AS inning,
       CASE WHEN g % 30 < 15 THEN 'Top' ELSE 'Bot' END AS inning_topbot,
       'H' || CAST(game % 30 AS STRING) AS home_team,
       'A' || CAST(game % 29 AS STRING) AS away_team,
       at_bat_number, pitch_number, outs_when_up, balls, strikes,
       CASE WHEN g % 15 > 0 AND r2 % 2 = 0 THEN CAST(batter AS STRING) ELSE 'NULL' END AS on_1b,
       CASE WHEN g % 15 > 0 AND r2 % 3 = 0 THEN CAST(batter + 1 AS STRING) ELSE 'NULL' END AS on_2b,
       CASE WHEN g % 15 > 0 AND r2 % 5 < 2 THEN CAST(batter + 2 AS STRING) ELSE 'NULL' END AS on_3b,
       CAST(FLOOR(g / 30.0) AS BIGINT) + CASE WHEN g % 15 >= 10 THEN (game + at_bat_number) % 3 ELSE 0 END AS bat_score,
       CAST(FLOOR(g / 30.0) AS BIGINT) + CASE WHEN g % 15 >= 10 THEN (game + at_bat_number) % 3 ELSE 0 END
         + CASE WHEN description = 'hit_into_play' AND r3 % 20 >= 16 THEN 1 ELSE 0 END AS post_bat_score,
       CASE WHEN description = 'hit_into_play' THEN
              CASE WHEN r3 % 20 < 11 THEN 'field_out' WHEN r3 % 20 = 11 THEN 'grounded_into_double_play'
                   WHEN r3 % 20 = 12 THEN 'sac_fly' WHEN r3 % 20 < 16 THEN 'single' WHEN r3 % 20 = 16 THEN 'double'
                   WHEN r3 % 20 = 17 THEN 'triple' WHEN r3 % 20 = 18 THEN 'home_run' ELSE 'field_error' END
            WHEN description = 'hit_by_pitch' THEN 'hit_by_pitch'
            WHEN description IN ('ball', 'blocked_ball', 'automatic_ball') AND balls = 3 THEN 'walk'
            WHEN description IN ('called_strike', 'swinging_strike', 'foul_tip') AND strikes = 2 THEN 'strikeout'
            ELSE 'NULL' END AS events,
       description, pitcher, p_throws, batter,
       CASE WHEN batter % 4 = 0 THEN CASE WHEN p_throws = 'R' THEN 'L' ELSE 'R' END
            WHEN batter % 2 = 0 THEN 'L' ELSE 'R' END AS stand,
       CASE WHEN r2 < 30 THEN 'FF' WHEN r2 < 48 THEN 'SL' WHEN r2 < 62 THEN 'SI' WHEN r2 < 74 THEN 'CH'
            WHEN r2 < 84 THEN 'CB' WHEN r2 < 95 THEN 'CT' WHEN r2 < 97 THEN 'KN' WHEN r2 < 99 THEN 'EP'
            ELSE 'NULL' END AS pitch_type_condensed,
       CASE WHEN h % 211 = 0 THEN 'NULL' ELSE CAST(80 + r3 % 20 AS STRING) END AS release_speed,
       CAST(r1 % 7 - 3 AS STRING) AS release_pos_x,
       CAST(50 + r2 % 6 AS STRING) AS release_pos_y,
       CAST(4 + r3 % 4 AS STRING) AS release_pos_z,
       CAST(r1 % 5 - 2 AS STRING) AS pfx_x,
       CAST(r3 % 4 - 1 AS STRING) AS pfx_z,
       CAST(r2 % 5 - 2 AS STRING) AS plate_x,
       CAST(r3 % 6 AS STRING) AS plate_z,
       CAST(1 + r1 % 2 AS STRING) AS sz_bot,
       CAST(3 + r1 % 2 AS STRING) AS sz_top,
       CASE WHEN h % 97 = 0 THEN 'NULL' WHEN r4 % 14 = 9 THEN '14' ELSE CAST(r4 % 14 + 1 AS STRING) END AS zone,
       CASE WHEN description = 'hit_into_play' THEN CAST(60 + r3 % 50 AS STRING) ELSE 'NULL' END AS launch_speed,
       CASE WHEN description = 'hit_into_play' THEN CAST(r4 - 20 AS STRING) ELSE 'NULL' END AS launch_angle
FROM k
