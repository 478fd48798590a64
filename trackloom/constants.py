"""Fixed values. They must equal the published ones for results to agree."""

# Feature vector of one frame, in order.
FEATURES = [
    "xVelocity", "xAcceleration", "yVelocity", "yAcceleration",
    "dist_preceding", "dist_following",
    "dist_leftPreceding", "dist_leftAlongside", "dist_leftFollowing",
    "dist_rightPreceding", "dist_rightAlongside", "dist_rightFollowing",
]

# The eight direction sectors, in feature order.
SECTORS = [
    "preceding", "following",
    "leftPreceding", "leftAlongside", "leftFollowing",
    "rightPreceding", "rightAlongside", "rightFollowing",
]

# Columns that name the eight neighbours in corpora which ship neighbour ids.
NEIGHBOR_ID_COLUMNS = [
    "precedingId", "followingId",
    "leftPrecedingId", "leftAlongsideId", "leftFollowingId",
    "rightPrecedingId", "rightAlongsideId", "rightFollowingId",
]

HISTORY = 12
SPLIT_RATIOS = (0.8, 0.1)
MISSING_DISTANCE = -1.0

FEET_TO_METERS = 0.3048
PIXELS_TO_METERS = 0.0421

# Frame period in seconds per dataset.
FRAME_PERIOD = {
    "HighD": 1 / 25, "inD": 1 / 25,
    "CitySim": 1 / 30, "DJI": 1 / 30,
    "sinD": 1 / 10, "NGSIM": 1 / 10,
    "INTERACTION_CHN": 1 / 10, "INTERACTION_DEU": 1 / 10, "INTERACTION_USA": 1 / 10,
}

# Agent classes counted as vehicles when routes are mined and matched.
ROUTE_VEHICLES = ["car", "truck", "bus", "vehicle", "motorcycle", "van", "2", "3"]

CITYSIM_SCENES = ["IntersectionA", "IntersectionB", "IntersectionD", "IntersectionE"]

STATUSES = ["assigned", "rejected_ignore_track", "unassigned", "excluded_non_vehicle", "invalid_too_short"]

# Match thresholds (segment mean, lateral mean, lateral p90) by kind of scene.
MATCH_THRESHOLDS = {
    "pixel": (120.0, 80.0, 160.0),
    "NGSIM": (10.0, 3.5, 8.0),
    "default": (6.0, 3.5, 8.0),
}
REJECT_SCALE = 0.7

KERNEL_BANDWIDTHS = (1.0, 2.0, 4.0, 8.0)

# Quantile ranges swept by the two slice reports.
SWEEP_RANGES = [
    (0.00, 0.05), (0.00, 0.10), (0.00, 0.15), (0.00, 0.20), (0.05, 0.20), (0.10, 0.25), (0.15, 0.30),
    (0.20, 0.35), (0.25, 0.45), (0.35, 0.55), (0.45, 0.65), (0.55, 0.75), (0.65, 0.85), (0.75, 0.92),
    (0.85, 0.97), (0.90, 1.00), (0.93, 1.00), (0.95, 1.00), (0.97, 1.00),
]
FINE_RANGES = [
    (0.00, 0.02), (0.00, 0.03), (0.00, 0.04), (0.00, 0.05), (0.00, 0.075), (0.00, 0.10), (0.02, 0.08),
    (0.03, 0.10), (0.05, 0.15), (0.075, 0.20), (0.10, 0.20), (0.15, 0.30), (0.20, 0.40), (0.30, 0.50),
    (0.40, 0.60), (0.50, 0.70), (0.60, 0.80), (0.70, 0.90), (0.80, 0.95), (0.85, 0.98), (0.90, 1.00),
]
GOOD_RANK_RANGES = [(0.00, 0.02), (0.00, 0.03), (0.00, 0.05), (0.00, 0.075), (0.00, 0.10), (0.00, 0.15)]
TAIL_RANK_RANGES = [
    (0.50, 0.70), (0.60, 0.80), (0.70, 0.85), (0.80, 0.90), (0.85, 0.95), (0.90, 0.98), (0.95, 1.00),
]

LONGTAIL_WEIGHTS = {
    "heading_change_rad": 0.42, "acc_p95": 0.28, "curvature_ratio": 0.18, "duration_sec": 0.12,
}
