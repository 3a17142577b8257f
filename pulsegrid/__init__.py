"""Detector-array event analytics as Spark DataFrame jobs."""
