"""They must equal the published rules for results to agree."""

# Court, in metres.
COURT_LENGTH = 30.5
COURT_WIDTH = 15.25
GOAL_CIRCLE_RADIUS = 4.9
CENTRE_CIRCLE_RADIUS = 0.9
SIDELINE_MARGIN = 0.5

# The shooting report measures on a rounded 30 x 15 court.
REPORT_LENGTH = 30.0
REPORT_WIDTH = 15.0

FPS = 30.0

POSITIONS = ["GS", "GA", "WA", "C", "WD", "GD", "GK"]
SHOOTERS = ["GS", "GA"]

# Position -> zones it may enter (left / right vocabulary).
POSITION_ZONES = {
    "GS": ["goal_circle_left", "goal_third_left"],
    "GA": ["goal_circle_left", "goal_third_left", "center_third"],
    "WA": ["goal_third_left", "center_third"],
    "C": ["center_third", "center_circle"],
    "WD": ["center_third", "goal_third_right"],
    "GD": ["goal_third_right", "center_third"],
    "GK": ["goal_circle_right", "goal_third_right"],
}

# Zone -> positions allowed and player limit (home / away vocabulary).
ZONE_RULES = {
    "goal_third_home": (["GS", "GA", "GK", "GD"], 4),
    "centre_third": (["WA", "C", "WD", "GA", "GD"], 5),
    "goal_third_away": (["GS", "GA", "GK", "GD"], 4),
    "shooting_circle_home": (["GS", "GA", "GK", "GD"], 4),
    "shooting_circle_away": (["GS", "GA", "GK", "GD"], 4),
}

# Zone assumed for a position when no coordinates exist.
ZONE_BY_POSITION = {
    "GS": "shooting_circle_home",
    "GA": "shooting_circle_home",
    "WA": "centre_third",
    "C": "centre_third",
    "WD": "centre_third",
    "GD": "shooting_circle_away",
    "GK": "shooting_circle_away",
}

# Possession.
POSSESSION_MAX_DISTANCE = 50.0
POSSESSION_MIN_CONFIDENCE = 0.5
POSSESSION_OVERLAP = 0.3
CONFIRM_FRAMES = 3
CONFIDENCE_ALPHA = 0.7
HELD_BALL_SECONDS = 3.0

# Report texts.
NO_VIOLATIONS = "No zone violations detected - system working correctly"
VIOLATION_ADVICE = {
    "out_of_bounds": "High out-of-bounds violations - check court boundary calibration",
    "goal_circle_overflow": "Goal circle overflow violations - implement team counting logic",
    "center_circle_overflow": "Center circle overflow violations - implement team counting logic",
    "position_restriction": "Position restriction violations - improve position detection accuracy",
    "critical": "High number of critical violations - review rule implementation",
}
EDGE_CASES = {
    "crowd": "Multiple players near ball",
    "air": "Ball in air - no clear possession",
    "unsure": "Low confidence possession assignment",
}
FAILURE_MODES = {
    "ball": "Frequent ball detection failures",
    "possession": "High rate of missed possession assignments",
}
VALIDATION_ADVICE = {
    "precision": "Improve precision by tuning confidence thresholds",
    "recall": "Improve recall by relaxing distance/overlap thresholds",
    "f1_score": "Balance precision and recall for better F1 score",
    "crowd": "Implement better multi-player possession resolution",
    "air": "Add temporal smoothing for ball-in-air scenarios",
    "unsure": "Review confidence calculation algorithm",
    "speed": "Optimize processing speed for real-time analysis",
}
CALIBRATION_ADVICE = {
    "hoops": "Low hoop detection rate - consider lowering confidence threshold",
    "success": "Low calibration success rate - check hoop positioning accuracy",
    "accuracy": "Low calibration accuracy - improve hoop detection quality",
}
LOAD_WARNINGS = {
    "cpu": "High CPU usage detected",
    "memory": "High memory usage detected",
    "disk": "Low disk space",
    "jobs": "Processor at maximum capacity",
}
