"""Corpus retrieval, evaluation and preparation as DataFrame-to-DataFrame functions."""
