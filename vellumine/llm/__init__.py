"""Training-data operators: archive, extraction, filtering, deduplication and tokenisation."""
