"""Fixed domain values. They must equal the published ones for results to match."""

# Seasons -------------------------------------------------------------------
TRAIN_SEASONS = tuple(range(2016, 2024))
GATE_SEASONS = (2024, 2025)
BASELINE_SEASONS = tuple(range(2016, 2026))
CHARTING_SEASONS = tuple(range(2022, 2026))

# Relocated clubs: code of the day -> modern code ----------------------------
RELOCATIONS = {"SD": "LAC", "OAK": "LV", "STL": "LA"}
# Modern code, last season under the old code, old code
ERA_CODES = (("LV", 2019, "OAK"), ("LAC", 2016, "SD"), ("LA", 2015, "STL"))

# Play filters ----------------------------------------------------------------
SCRIMMAGE_TYPES = ("pass", "run")
SCORING_PLAY_TYPES = ("pass", "run", "punt", "field_goal", "extra_point", "kickoff")
WP_BAND = (0.05, 0.95)
METER_EXPLOSIVE = {"pass": 20, "run": 12}  # strictly above
DRIVE_EXPLOSIVE = {"pass": 16, "run": 12}  # at or above
RED_ZONE_YARDS = 20
LATE_DOWNS = (3, 4)
CLOSE_SCORE = 8

# Fold rules: name -> (takeaway definition, drop takeaways returned for a score)
FOLD_RULES = {
    "int": ("int", False),
    "take": ("take", False),
    "int_notd": ("int", True),
    "take_notd": ("take", True),
}

# Scoring of record -----------------------------------------------------------
WEIGHT_COLUMNS = ("intercept", "own_success_rate_for", "own_ypp_for")
WEIGHTS_PIN = (-16.829, 35.126, 4.178)
MARGIN_SD_PIN = 8.875
SIGMA_OF_RECORD = 5.4528
DRAWS_OF_RECORD = 40_000
SEED_OF_RECORD = 0
ARM_OF_RECORD = "foldn_take_sr"
PIN_DECIMALS = 3
INTERVAL = (5.5, 94.5)
SCALE_FLOOR = 5.0
SEAM_LINE = 1e-12
SIDES_TOLERANCE = 1e-9
EXPECTED_GATE_GAMES = 543
EXPECTED_TRAIN_ROWS = 4190
COEFFICIENT_LINE = 5e-4
SCALE_DECIMALS = 4
SCALE_LINE = 5e-5
WEIGHTS_OF_RECORD = {
    "mean": (-16.82928858521862, 35.126158542744385, 4.17779695298846),
    "cov": (
        (0.44744359140931866, -0.8344795964530172, -0.011417952905383031),
        (-0.8344795964530172, 3.5714984127365432, -0.13067200144483776),
        (-0.011417952905383031, -0.13067200144483776, 0.012086565677481221),
    ),
    "sigma2": 48.56436356137636,
    "margin_sd": 8.87539206933968,
    "n_rows": 4190,
}
SIDE_STATS = ("plays", "yards", "ypp", "success_rate", "k", "n", "y_mean", "y_sd", "n_y")
SCORE_COLUMNS = (
    "game_id", "season", "week", "home", "away", "home_score", "away_score",
    "home_deserved", "away_deserved", "deserved_margin", "p_home",
    *(f"{side}_{stat}" for side in ("home", "away") for stat in SIDE_STATS),
)

# Readiness and validation ------------------------------------------------------
PLAY_FLOOR = 25
MIN_PLAYS_PER_GAME = 90
MAX_PLAYS_PER_GAME = 300
PLAY_REQUIRED = (
    "game_id", "season", "week", "posteam", "defteam", "home_team", "away_team",
    "play_type", "epa", "fumble", "fumble_lost", "fumble_recovery_1_team",
    "interception", "field_goal_result", "kick_distance", "penalty",
    "penalty_team", "penalty_yards", "spread_line",
)
CHARTING_REQUIRED = (
    "nflverse_game_id", "nflverse_play_id", "is_interception_worthy",
    "is_catchable_ball", "n_pass_rushers",
)

# Studies -----------------------------------------------------------------------
POINTS_PER_EPA = 0.8389
MIN_GAMES = 8
FORM_WINDOW = 17
MIN_HISTORY = 8
MIN_CLASS = 30
MIN_PER_BRANCH = 30
MIN_BIN_DRIVES = 100
DEPTH_BIN_WIDTH = 5
RESAMPLED_RESULTS = ("Touchdown", "Field goal", "Punt", "Turnover", "Turnover on downs",
                     "Missed field goal")
WIND_CAP = 30.0
INDOOR_ROOFS = ("dome", "closed")
TRY_WINDOW = 15
ONSIDE_SECONDS = 300
VERDICT_BAND = (0.40, 0.60)
DEGENERATE = (0.001, 0.999)
MOVER_POINTS = 3.0
YARD_BINS = ((1, 33, "1-33"), (34, 66, "34-66"), (67, 99, "67-99"))
DOWN_BINS = (((1, 2), "1-2"), ((3, 4), "3-4"))
# Share of an error-function approximation (Abramowitz and Stegun 7.1.26)
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
