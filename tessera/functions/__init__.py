"""Scalar and aggregate functions with the engine's null, truth and aggregate rules."""
