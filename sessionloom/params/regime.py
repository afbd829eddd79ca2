"""Market regime parameters (fixed values)."""

# dimension: (weight, [(metric, normaliser, low, high, center, weight)])
DIMENSIONS = {
    "trend": (30, [
        ("broad_return_20", "linear", -0.08, 0.08, None, 35),
        ("broad_return_5", "linear", -0.03, 0.03, None, 25),
        ("broad_above_sma20_share", "linear", 0.25, 0.75, None, 20),
        ("broad_direction_agreement", "linear", 0.25, 0.75, None, 20)]),
    "breadth": (25, [
        ("advancer_share_1", "linear", 0.35, 0.65, None, 25),
        ("positive_return_share_5", "linear", 0.35, 0.65, None, 25),
        ("above_sma20_share", "linear", 0.30, 0.70, None, 30),
        ("high_low_balance_20", "linear", -0.10, 0.10, None, 20)]),
    "volatility": (20, [
        ("spy_realized_volatility_10", "declining", 0.10, 0.35, None, 35),
        ("median_stock_realized_volatility_10", "declining", 0.25, 0.80, None, 25),
        ("downside_tail_frequency_5", "declining", 0.0, 0.08, None, 20),
        ("cross_sectional_dispersion_1", "declining", 0.01, 0.04, None, 20)]),
    "liquidity_participation": (15, [
        ("aggregate_participation_ratio", "linear", 0.75, 1.25, None, 40),
        ("up_participation_share", "linear", 0.35, 0.65, None, 30),
        ("above_own_volume_median_share", "linear", 0.35, 0.65, None, 30)]),
    "leadership_dispersion": (10, [
        ("winner_concentration_5", "declining", 0.35, 0.70, None, 45),
        ("benchmark_direction_agreement_5", "linear", 0.25, 0.75, None, 30),
        ("return_dispersion_5", "triangular", 0.005, 0.08, 0.025, 25)]),
}
MINIMUM_DIMENSION_WEIGHT = 70
MINIMUM_COMPOSITE_WEIGHT = 90
REQUIRED_DIMENSIONS = ("trend", "breadth", "volatility")

# state bands and confirmation rules: (current, target, operator, threshold, sessions)
BANDS = (("risk_on", 70.0), ("balanced", 50.0), ("defensive", 30.0), ("stress", None))
STRESS_NOW = 20.0
RULES = (
    ("risk_on", "balanced", "<", 65.0, 2),
    ("balanced", "risk_on", ">=", 70.0, 2),
    ("balanced", "defensive", "<", 45.0, 2),
    ("defensive", "balanced", ">=", 55.0, 2),
    ("defensive", "stress", "<", 30.0, 2),
    ("stress", "defensive", ">=", 35.0, 3),
)
BOOTSTRAP_SESSIONS = 2
