"""Training-data operators: text scanning, deduplication, tokenisation."""
