"""Operators for training-data pipelines: identification, deduplication, decontamination, extraction, scoring,
tokenisation and chat formatting.  Nothing else in the library imports this subpackage."""
