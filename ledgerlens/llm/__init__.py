"""Operators of a training-data pipeline: scoring, mixing, deduplication, extraction, decontamination, packing."""
