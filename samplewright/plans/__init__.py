"""Chained epoch plan and the query catalogue."""
