"""Athlete-tracking analytics as Spark DataFrame jobs."""
