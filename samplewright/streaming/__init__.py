"""Incremental batch assembly and run counters."""
