"""Operators for building training data from document corpora. Nothing outside this folder imports it."""
