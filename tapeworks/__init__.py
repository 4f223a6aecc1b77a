"""Spark operators for price-bar analytics (bars, signals, trades, risk)."""
