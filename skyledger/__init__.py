"""Observation analytics and corpus preparation on Spark."""
