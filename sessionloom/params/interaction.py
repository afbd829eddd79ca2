"""Registered interaction hypotheses and the protocol's floors (fixed values)."""

PRIMARY_HORIZON, HORIZONS = 3, (1, 3, 5)
BLOCKS, REPLICATES = (10, 20), 10_000
MINIMUM_SESSIONS, MINIMUM_HALF, MINIMUM_FAVOURABLE = 80, 40, 20
ALPHA = 0.05
MAXIMUM_SELECTED = 1
ENDPOINTS = {"candidate_alpha": ("lower", "upper"), "risk_guard": ("complete_path",)}
# id: (role, factor, sign, state metric, transform)
HYPOTHESES = {
    "acceleration_in_trend": ("candidate_alpha", "relative_acceleration", 1, "market_20", "as_defined"),
    "efficiency_in_breadth": ("candidate_alpha", "signed_path_efficiency", 1, "up_share", "centred_share"),
    "strength_in_breadth": ("candidate_alpha", "relative_return_20", 1, "up_share", "centred_share"),
    "volume_in_trend": ("candidate_alpha", "dollar_volume_surprise", 1, "market_5", "as_defined"),
    "drawdown_in_decline": ("risk_guard", "max_drawdown", 1, "market_20", "negated"),
    "range_in_volatility": ("risk_guard", "atr_ratio_5_14", -1, "rv20", "as_defined"),
}
INCONCLUSIVE = ("eligible_session_floor_not_met", "first_half_session_floor_not_met", "regression_unavailable", "second_half_session_floor_not_met")
