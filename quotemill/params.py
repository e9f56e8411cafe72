"""Parameters of the tick-analytics operators.  Fixed values that results depend on stand together here."""

from __future__ import annotations

from dataclasses import dataclass, field

# Periods, windows and thresholds of the indicator, structure, gap and sweep rules.
ATR_1M, ATR_15M, ATR_5M, RSI, EMA = 20, 15, 14, 14, 20
FRACTAL_LEFT, FRACTAL_RIGHT_MIN, FRACTAL_RIGHT_MAX, R_FACTOR = 5, 2, 5, 3.0
FRACTAL_4H, FRACTAL_1M = 5, 3
DISPLACEMENT, GAP_ATR, GAP_FLOOR, GAP_AGE = 0.5, 0.15, 3.0, 20
SWEEP_ATR, SWEEP_FLOOR, EQUAL_ATR, EQUAL_LOOKBACK, EQUAL_SIZE, CONSUMED_BARS = 0.15, 2.0, 0.25, 80, 2, 5
SESSIONS = (("newyork", 13, 22), ("london", 8, 17), ("asian", 0, 9))
SESSION_STARTS = (("newyork", 13), ("london", 8))
LOT_USD, MIN_NOTIONAL = 100_000.0, 1_000.0
SPREAD_ATR, GAP_WIDE, SCORE_WITH, SCORE_AGAINST, TIMEOUT_MS = 0.25, 15.0, 4, 7, 600_000
PIP, PIP_VALUE, WIDE_PIPS, CAPITAL = 0.10, 10.0, 20.0, 10_000.0
T1_BUFFER, T2_BUFFER, TRAIL_BUFFER, P1_ATR, P2_ATR, P2_GAP, TP_RATIO, RISK = 4.0, 2.5, 2.5, 0.3, 1.25, 0.3, 2.0, 0.01
# Fixed values of the older engine (v3).
V3_WINDOW, V3_SWING_ATR, V3_CONFLUENCE, V3_SWEEP, V3_NEAREST = 5, 0.5, 0.002, 0.0005, 3
V3_TIMEFRAME_BONUS = {"1d": 3, "4h": 2, "1h": 1}
V3_KILLZONE = (7, 9)
METALS = ("XAUUSD", "XAGUSD")
METAL_DIVISOR, FX_DIVISOR, VOLUME_SCALE = 1_000.0, 100_000.0, 1_000_000.0

# Our own bounds of what a live run remembers: 15-minute bars for the median ATR, snapshots whose levels can be swept.
MEDIAN_BARS, LEVEL_SNAPSHOTS = 672, 9

KEY = ("symbol", "source")


@dataclass
class BacktestParams:
    capital: float = CAPITAL
    pip: float = PIP
    pip_value: float = PIP_VALUE
    wide_pips: float = WIDE_PIPS
    timeout_ms: int = TIMEOUT_MS
    relay: str = "compat"
    align_bias: bool = False
    keys: tuple[str, ...] = field(default=KEY)
