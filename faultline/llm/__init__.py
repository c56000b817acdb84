"""Corpus operators for training data: extraction, scoring, deduplication, decontamination, mixing."""
