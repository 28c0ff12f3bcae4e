"""Writers for corpora, feature tables, parse caches, metadata and results."""
