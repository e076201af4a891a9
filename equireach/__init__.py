"""Spatial-accessibility and inequality analytics as Spark DataFrame operators."""
