"""Claim consistency and risk triage on Spark DataFrames."""
