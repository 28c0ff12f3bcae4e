"""Readers for text files, raw splits, corpora, feature tables and parse caches."""
