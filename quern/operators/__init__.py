"""Operators over DataFrames: retrieval, fusion, truncation, calibration, maintenance, evaluation, generation."""
