"""Readers: each gives a DataFrame of raw or canonical records."""
