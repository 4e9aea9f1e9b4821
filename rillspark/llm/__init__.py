"""Operators for building training corpora from text and vector tables."""
