"""Operators for building training corpora: classifiers, deduplication, decontamination, tokens, chat calls."""
