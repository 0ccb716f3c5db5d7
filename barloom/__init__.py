"""Market-series research on Spark: bars, calendars, checks, signals, backtests and metrics as DataFrame operators."""

__version__ = "0.1.0"
