"""Curve-shape analytics on Spark: features, classes, factors, validation, attribution."""
