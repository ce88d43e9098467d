"""Training-data operators: dedup, language ID, packing, search, archives."""
