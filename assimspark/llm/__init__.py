"""Training-data operators: text quality, privacy, packing, scoring and formatting jobs."""
