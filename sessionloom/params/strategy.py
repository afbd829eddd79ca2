"""Parameters of the strategy statistics (fixed values)."""

HORIZONS = (1, 3, 5)
PRIMARY_HORIZON = 3
SCENARIOS = ("all_lower", "all_upper", "contrast_adverse")
STATES = ("observed_eod_exact", "terminal_reference_exact", "terminal_reference_interval", "unavailable_evidence", "unexecutable_no_next_open")
NUMERIC = STATES[:3]
REGIMES = ("risk_on", "balanced", "defensive", "stress")
COSTS_BPS = (0, 10, 25, 50)
REPLICATES, BLOCK = 2000, 5
MINIMUM_SIGNALS, MINIMUM_SESSIONS, REGIME_FLOOR = 60, 20, 60
COMBINATIONS = 24
# replacement selection: gate -> (metric, comparison, threshold)
ROBUSTNESS_GATES = (
    ("positive_adverse_lower_90pct", "lower", ">", 0.0),
    ("positive_25bps_median_spy_relative", "median_relative_net_25", ">", 0.0),
    ("positive_first_half_contrast", "first_half_contrast", ">", 0.0),
    ("positive_second_half_contrast", "second_half_contrast", ">", 0.0),
    ("positive_paired_session_majority", "positive_ratio", ">", 0.5),
    ("bounded_single_session_concentration", "concentration", "<=", 0.2),
)
HOLM_ALPHA = 0.10
