"""Thresholds of the entry review, in multiples of ATR, volatility units, volume and score points."""

SCORE_FLOOR, STRONG_SCORE, BREAKOUT_SCORE, COMPONENT_FLOOR = 50.0, 65.0, 70.0, 55.0
# distance to SMA20 in ATR, five-session move in volatility units
EXTENDED = {"moderate": (1.5, 1.0), "high": (2.5, 1.75), "extreme": (3.5, 2.5)}
# rising closes in a row with the distance to SMA10 in ATR
RUN = {"moderate": (3, 1.0), "high": (4, 1.5)}
GAP = {"moderate": 1.0, "extreme": 1.5}
CLIMAX_VOLUME, CLIMAX_RANGE, CLIMAX_LOCATION = 2.0, 1.5, 0.75
BREAKOUT_DISTANCE, BREAKOUT_VOLUME, BREAKOUT_LOCATION = 0.75, (1.2, 2.5), 0.6
WATCH_DISTANCE, WATCH_VOLUME = 0.75, 2.0
PULLBACK_NEAR, PULLBACK_DEPTH, PULLBACK_VOLUME, PULLBACK_LOCATION = 0.75, (0.25, 2.0), 1.2, 0.35
# entries shown in a lane of a risk mode
LANE_CAP = 8

# weights of components in a channel's score, and what the setup counts in it; scores of channels are never compared
CHANNEL_WEIGHTS = {
    "momentum_breakout": {"stock_relative_strength": 0.35, "trend_quality": 0.25, "volume_participation": 0.15, "setup": 0.25},
    "strong_stock_pullback": {"stock_relative_strength": 0.30, "trend_quality": 0.25, "volatility_risk": 0.15, "liquidity_suitability": 0.10, "setup": 0.20},
    "trend_continuation": {"stock_relative_strength": 0.35, "trend_quality": 0.35, "volume_participation": 0.15, "volatility_risk": 0.10, "setup": 0.05},
}
SETUP_SCORES = {
    "momentum_breakout": {"breakout_confirmed": 100.0, "breakout_watch": 70.0, "pullback": 25.0, "strong_but_extended": 15.0, "no_viable_setup": 20.0},
    "strong_stock_pullback": {"breakout_confirmed": 25.0, "breakout_watch": 35.0, "pullback": 100.0, "strong_but_extended": 55.0, "no_viable_setup": 20.0},
    "trend_continuation": {"breakout_confirmed": 85.0, "breakout_watch": 70.0, "pullback": 85.0, "strong_but_extended": 35.0, "no_viable_setup": 50.0},
}
TREND_ADVANCE, TREND_WATCH, TREND_WATCH_BASE = 65.0, 55.0, 65.0
