"""Training-data operators: tokenisation, extraction, deduplication, filtering and scoring of text."""
