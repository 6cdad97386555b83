"""Indicators and frame-level operators."""
