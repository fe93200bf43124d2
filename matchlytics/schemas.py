"""Columns of the tables that operators take and give, as DDL.

Times are seconds from the start of the match or clip; frames count from 0. Ordered tables carry their
tie-break (`seq`, `det_ord`, `pos`, `ord`), because rows of a table have no order of their own.
"""

from __future__ import annotations

# meta of a signal, one nullable column per key of any detector
SIGNAL_META = {"zscore": "double", "short_scenes": "bigint", "score": "string", "prev": "string", "minute": "int",
               "kind_hint": "string", "phrase": "string", "text": "string", "label": "string"}

SIGNALS = "match_id bigint, t double, seq bigint, source string, strength double, " + ", ".join(
    f"{name} {kind}" for name, kind in SIGNAL_META.items())
MOMENTS = ("match_id bigint, t double, start_s double, end_s double, confidence double, kind string, minute int, "
           "sources array<string>, signal_count bigint")
MEDIA = "media_id bigint, duration double, width int, height int, fps double, has_audio boolean"
LOUDNESS = "match_id bigint, idx bigint, t double, rms double"
SCENES = "match_id bigint, seq bigint, start_s double, end_s double"
SCOREBOARD_TEXTS = "match_id bigint, seq bigint, t double, text string"
SEGMENTS = "match_id bigint, seq bigint, start_s double, text string"
SPOTS = "match_id bigint, seq bigint, t double, label string, conf double"
CLIPS = "clip_id bigint, width int, height int, fps double, n_frames int"
PLAYERS = "clip_id bigint, frame bigint, track_id bigint, det_ord bigint, cx double, cy double"
DETECTIONS = ("clip_id bigint, frame bigint, det_ord bigint, model string, class_id bigint, conf double, "
              "x1 double, y1 double, x2 double, y2 double")
BALL = "clip_id bigint, frame bigint, ball_x double, ball_y double"
HOMOGRAPHY = "clip_id bigint, frame bigint, h array<double>"
KEYPOINTS = "clip_id bigint, frame bigint, kp_idx int, x double, y double, conf double"
CLIP_STATS = ("clip_id bigint, key_track_id bigint, metric boolean, sprint_distance_m double, top_speed_kmh double, "
              "shot_distance_m double, players_beaten bigint")
WORDS = "clip_id bigint, turn bigint, pos bigint, word string, start_s double, end_s double"
CAPTION_LINES = "clip_id bigint, line_no bigint, text string, start_s double, end_s double"
REEL_ITEMS = "reel_id bigint, ord bigint, duration double, confidence double, kind string"
FILES = "dir string, path string, size bigint"
LOG_LINES = "run_id bigint, line_no bigint, line string"
SETTINGS = "match_id bigint, path string, value string"
