"""Operators of a training-data pipeline: dedup, quality, mixing, decontamination, PII, chat, sharding.

Nothing else in the library imports this subpackage."""
