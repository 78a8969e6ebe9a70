"""Joins, trades, portfolios and statistics on bar and panel tables."""
