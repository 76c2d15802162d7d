"""Training-data operators: archives, deduplication, filters, extraction and packing."""
