"""Corpus operators for training data: deduplication, decontamination, scoring, tokenization, conversations."""
