"""Behavioural text analytics on Spark: risk series, phases, coverage and topics for all users at once."""

__version__ = "0.1.0"
