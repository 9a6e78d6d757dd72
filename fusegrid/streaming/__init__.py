"""Incremental ingestion, beyond what a batch run offers."""
