"""Relational and time-series operators; each takes and returns DataFrames and triggers no job unless it says so."""
