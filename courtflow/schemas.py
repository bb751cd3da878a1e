"""Record layouts of the tables that are read and written."""

GAME_RESULTS = (
    "game_id long, home_team string, away_team string, home_score long, away_score long, category string, game_date date"
)
DETECTIONS = (
    "match_id long, frame_number long, ts_sec double, det_no long, class_name string, x1 double, y1 double, x2 double, "
    "y2 double, confidence double, track_id long, team string, position string, court_x double, court_y double"
)
POSSESSION_CHANGES = (
    "match_id long, player_id long, start_frame long, end_frame long, start_timestamp double, end_timestamp double, "
    "duration_frames long, duration_seconds double"
)
THREE_SECOND_VIOLATIONS = (
    "match_id long, player_id long, start_frame long, violation_frame long, start_timestamp double, "
    "violation_timestamp double, duration_seconds double, excess_seconds double"
)
POSSESSION_DATA = (
    "match_id long, frame_number long, timestamp double, possession_player_id long, possession_confidence double, "
    "possession_reason string, ball_count long, player_count long"
)
SHOT_ATTEMPTS = (
    "match_id long, frame_number long, timestamp double, player_id long, shooting_circle string, ball_x double, "
    "ball_y double, player_x double, player_y double, shot_distance double, shot_angle double, confidence double"
)
ZONE_VIOLATIONS = (
    "match_id long, frame_number long, timestamp double, player_id long, violation_type string, zone_name string, "
    "severity string, description string"
)
FRAME_DETECTIONS_JSON = (
    "match_id long, frame_number long, timestamp double, player_count long, ball_count long, hoop_count long, "
    "player_detections_json string, ball_detections_json string, hoop_detections_json string"
)
DETECTION_ITEMS = "array<struct<x1:double,y1:double,x2:double,y2:double,confidence:double,class_name:string>>"
CALIBRATIONS = (
    "match_id long, from_frame long, homography_matrix array<array<double>>, method string, confidence double, "
    "reference_points array<array<double>>, court_dimensions struct<length:double,width:double>, timestamp double, "
    "status string"
)
GROUND_TRUTH = (
    "match_id long, annotations array<struct<frame_number:long,timestamp:double,true_possession_player:long,"
    "true_possession_confidence:double,notes:string>>"
)
_METRICS = (
    "struct<total_frames:long,true_positives:long,false_positives:long,false_negatives:long,true_negatives:long,"
    "precision:double,recall:double,f1_score:double,accuracy:double,processing_time_per_frame:double>"
)
VALIDATION_REPORTS = (
    f"video_name string, segment_start double, segment_end double, metrics {_METRICS}, edge_cases_found array<string>, "
    "failure_modes array<string>, recommendations array<string>, _corrupt_record string"
)
_POINT = "struct<x:double,y:double,confidence:double>"
ANALYSIS_RESULTS = (
    "game_id string, config map<string,string>, "
    "players array<struct<track_id:long,team:string,position:string,jersey_number:long,current_zone:string,"
    "possession_time:double,is_in_possession:boolean>>, "
    f"ball_trajectory array<{_POINT}>, "
    "possession_events array<struct<timestamp:double,player_id:long,team:string,event_type:string,zone:string>>, "
    f"shot_events array<struct<timestamp:double,shooter_id:long,team:string,position:{_POINT},result:string,zone:string,"
    "distance_to_goal:double>>, "
    "game_state struct<timestamp:double,period:long,home_score:long,away_score:long,possession_team:string,"
    "possession_player_id:long,possession_start_time:double>, "
    "standings array<struct<team_name:string,games_played:long,wins:long,draws:long,losses:long,goals_for:long,"
    "goals_against:long,goal_difference:long,goal_average:double,points:long>>, "
    "processing_time double, frame_count long, fps double"
)
