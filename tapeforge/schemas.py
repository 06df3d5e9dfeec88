"""Table schemas and the fixed formation settings."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _L, _I, _S, _TS = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PRICE_COLS = ["open", "high", "low", "close"]
FEATURE_COLS = [*PRICE_COLS, "volume"]

BARS = _struct(("symbol", _S), ("ts", _TS), *[(c, _D) for c in FEATURE_COLS])

# Ten statistics stored with a fired signal.
STAT_COLS = ["proj_move_usd", "slope_upper", "slope_lower", "apex_min", "apex_price", "mid_travel",
             "convergence", "touch_up", "touch_lo", "max_excursion"]

SCORES = _struct(("symbol", _S), ("ts", _TS), ("pattern", _S), ("window", _I), ("score", _D),
                 ("signal", _I), ("bars", _I))
SIGNALS = _struct(("symbol", _S), ("ts", _TS), ("pattern", _S), ("window", _I),
                  *[(c, _D) for c in STAT_COLS])
SESSIONS = _struct(("date", T.DateType()), ("open_time", _S), ("close_time", _S))
CORPUS = _struct(("window_id", _L), ("type", _S), ("split", _S), ("bar", _I),
                 ("open", T.FloatType()), ("high", T.FloatType()), ("low", T.FloatType()),
                 ("close", T.FloatType()), ("volume", T.FloatType()),
                 ("lower_trendline", T.FloatType()), ("upper_trendline", T.FloatType()),
                 ("segment", T.ByteType()), ("label", T.ByteType()))
MANIFEST = _struct(("label", _I), ("type", _S), ("original_idx", _L), ("shuffled_idx", _L),
                   ("filename", _S), ("split", _S), ("date_start", _S), ("date_end", _S))

DEFAULT_PATTERN = "wedge"
KEY_SCORES = ["symbol", "ts", "pattern", "window"]
KEY_BARS = ["symbol", "ts"]

# Formation settings. `geometry` False means "score only".
# A null band limit means "no limit".
FORMATIONS = [
    dict(pattern="wedge", window=250, threshold=0.8, apex_gate=True, quality_gate=True, geometry=True,
         log_only=False, fit_bars=100, min_conv=0.5, max_conv=None, min_touches=5, max_exc=1.83),
    dict(pattern="channel", window=250, threshold=0.9, apex_gate=False, quality_gate=True, geometry=True,
         log_only=False, fit_bars=100, min_conv=-0.30, max_conv=0.35, min_touches=5, max_exc=None),
    dict(pattern="hs", window=250, threshold=0.9, apex_gate=False, quality_gate=False, geometry=False,
         log_only=True, fit_bars=None, min_conv=None, max_conv=None, min_touches=None, max_exc=None),
    dict(pattern="inverse_hs", window=250, threshold=0.9, apex_gate=False, quality_gate=False, geometry=False,
         log_only=True, fit_bars=None, min_conv=None, max_conv=None, min_touches=None, max_exc=None),
]

# Projected-move line, apex horizon, touch tolerance, regular session.
PROJ_INTERCEPT_PCT = 1.034
PROJ_TRAVEL_COEF = -0.146
APEX_MAX_AHEAD = 360
TOUCH_TOLERANCE = 0.18
OUTSIDE_TOLERANCE = 0.02
SESSION_OPEN = "09:30:00"
SESSION_CLOSE = "16:00:00"
SESSION_MINUTES = 390

# Corpus split fractions and family-report thresholds.
TRAIN_FRACTION = 0.72
VAL_FRACTION = 0.08
FAMILY_THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
