"""Inputs: tables, bars from event rows, generated series."""
