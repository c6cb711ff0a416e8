"""Training-data operators: language-model scoring, token output, deduplication, filters and fingerprints."""
