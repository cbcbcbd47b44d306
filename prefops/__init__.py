"""Preference-data and reward-scoring operators for Spark DataFrames."""
