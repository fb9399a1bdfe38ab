"""Lapwing: competition-results analytics and integrity checks on Spark DataFrames."""
