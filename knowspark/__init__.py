"""Versioned, evidence-backed knowledge objects as Spark DataFrames."""
