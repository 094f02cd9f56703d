"""Sequence analytics and corpus preparation on Spark."""
