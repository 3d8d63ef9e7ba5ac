"""Scalar functions: durations, time stamps, names."""
