"""Training-data operators: language ID, deduplication, decontamination, packing, WARC."""
