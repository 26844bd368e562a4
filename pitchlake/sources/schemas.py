"""Explicit schemas of the engine's tables; nothing is inferred."""

PLAYERS = "match_id string, track_id int, t double, x1 float, y1 float, x2 float, y2 float, conf float"
TRACK_META = "match_id string, track_id int, team int, team_confidence double, jersey_color_hex string, jersey_number int, label string, source_track_ids array<int>"
BALL_RAW = "match_id string, t double, x float, y float, w float, h float, conf float"
MATCH_TRACKING = "match_id string, fps double, frame_w int, frame_h int, duration_s double, trim_offset_s double, vid_stride int, focus_track_id int, proxy_scale double"
SEGMENTS = "match_id string, start_s double, end_s double, state string, side string"
EVENTS = "match_id string, event_id string, type string, t double, t_start double, t_end double, team int, track_id int, confidence double, excitement double, sources array<string>"
ROSTER = "match_id string, entry_id string, player_name string, jersey_number string, position string, email string, team_side string"
