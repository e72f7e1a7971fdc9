"""Settings and fixed values shared by the operators."""

from __future__ import annotations

ANN_DAYS = 252
MONTHS_PER_YEAR = 12

# --- fixed values: quote fields, their roles, and their order of preference ---
FIELD_ROLES = {"PX_LAST": "mid", "PX_BID": "bid", "PX_ASK": "ask"}
FIELD_PRIORITY = {"PX_LAST": 0, "PX_BID": 1, "PX_ASK": 2}

# --- fixed values: ticker suffixes and tenors ---
TICKER_SUFFIXES = ("Curncy", "Index", "Comdty")
TENORS = ("1W", "1M", "3M", "6M", "12M")
TENOR_MONTHS = {"1M": 1, "3M": 3, "6M": 6, "12M": 12}
TICKER_PATTERN = rf"^([A-Z0-9]{{3}})({'|'.join(TENORS)})?\s+CURNCY__({'|'.join(FIELD_ROLES)})$"

# --- fixed values: option ticker pieces ---
OPTION_TYPES = ("V", "25R", "25B", "10R", "10B")
OPTION_TENORS = ("1W", "1M", "3M", "6M", "1Y")

# --- fixed values: thresholds of the forward-quote classifier ---
FORWARD_MIN_OBS = 24
FORWARD_RATIO_RANGE = (0.98, 1.02)
FORWARD_MAX_REL_DIFF = 0.02
FORWARD_SANITY = 0.25

# --- fixed values: baskets and regime labels ---
LONG_BASKET = "long_high_carry"
SHORT_BASKET = "short_low_carry"
MIDDLE_BASKET = "middle"
REGIME_LABELS = ("Low", "Moderate", "Crisis")
REGIME_BREAKS = (0.70, 0.90)

# --- fixed values: cost grids in basis points and stress grids ---
ROLL_COST_BPS = (2, 5, 10, 25, 50)
COST_MULTIPLES = (1.0, 1.5, 2.0, 3.0, 5.0)
LAG_DAYS = (0, 1, 2, 3, 5)

LONG_SCHEMA = "date date, ticker string, field string, value double"
