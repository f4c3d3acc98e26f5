"""Operators of a training-data pipeline: dedup, decontamination, PII, quality, mixing."""
