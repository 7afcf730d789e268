SELECT event_id,
       CASE WHEN event_id % 701 = 13 THEN NULL ELSE game_pk END AS game_pk,
       inning, inning_topbot, home_team, away_team, at_bat_number,
       CASE WHEN event_id % 97 = 1 AND pitch_number > 1 THEN pitch_number - 1
            ELSE pitch_number END AS pitch_number,
       outs_when_up, balls, strikes, on_1b, on_2b, on_3b,
       CASE WHEN event_id % 9973 = 3457 THEN NULL ELSE bat_score END AS bat_score,
       CASE WHEN event_id % 2001 = 3 THEN NULL ELSE post_bat_score END AS post_bat_score,
       events,
       CASE WHEN event_id % 2503 = 14 THEN NULL ELSE description END AS description,
       CASE WHEN event_id % 509 = 12 THEN NULL ELSE pitcher END AS pitcher,
       CASE WHEN pitcher % 5 = 1 THEN CASE WHEN event_id % 3 = 0 THEN 'L' ELSE 'R' END
            ELSE p_throws END AS p_throws,
       CASE WHEN event_id % 503 = 11 THEN NULL ELSE batter END AS batter,
       CASE WHEN batter % 4 = 2 THEN CASE WHEN event_id % 2 = 0 THEN 'L' ELSE 'R' END
            ELSE stand END AS stand,
       pitch_type_condensed, release_speed, release_pos_x, release_pos_y, release_pos_z,
       pfx_x, pfx_z, plate_x, plate_z, sz_bot, sz_top, zone, launch_speed, launch_angle
FROM pitches
