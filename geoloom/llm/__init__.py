"""Training-data operators: text quality, deduplication, decontamination, mixing and scanning."""
