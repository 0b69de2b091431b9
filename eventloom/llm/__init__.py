"""Operators for large text corpora: quality, tokens, secrets, records, archives, duplicates, benchmarks, pages, privacy, toxicity."""
