"""Candidate score parameters (fixed values)."""

# component: (weight, [(metric, weight)])
COMPONENTS = {
    "market_alignment": (12, [("n_regime", 100)]),
    "etf_sector_alignment": (13, [("s_driver_rel5", 40), ("s_stock_driver5", 35), ("n_driver_corr", 25)]),
    "stock_relative_strength": (25, [("s_rel5", 45), ("s_rel20", 35), ("p_r20", 20)]),
    "trend_quality": (18, [("n_above10", 35), ("n_sma", 35), ("n_dd", 30)]),
    "volume_participation": (12, [("s_volume", 50), ("participation", 25), ("n_persistence", 25)]),
    "volatility_risk": (10, [("n_rv", 50), ("n_gap", 30), ("n_tail", 20)]),
    "liquidity_suitability": (10, [("n_dv", 70), ("n_price", 30)]),
}
SECTOR_CAP = 70.0
MINIMUM_WEIGHT = 80
REQUIRED_HISTORY = 21
CONFIDENCE = {"source": 0.40, "history": 0.25, "relationship": 0.20, "state": 0.15}
LOW_RELATIONSHIP = 0.35
# normaliser: (column, kind, low, high)
NORMALISERS = {
    "n_driver_corr": ("driver_corr", "linear", 0.35, 0.80),
    "n_sma": ("sma_spread", "linear", -0.03, 0.03),
    "n_dd": ("dd_abs", "declining", 0.02, 0.12),
    "n_rv": ("rv10", "declining", 0.25, 1.00),
    "n_gap": ("max_gap", "declining", 0.03, 0.20),
    "n_tail": ("tail_share", "declining", 0.0, 0.40),
    "n_dv": ("median_dv", "log", 5e6, 1e8),
    "n_price": ("close", "linear", 2.0, 20.0),
}
