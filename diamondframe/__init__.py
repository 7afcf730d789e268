"""Pitch-by-pitch baseball analytics as Spark DataFrame operators."""
