"""Training-data operators: URL filters, language ID, quality rules, tokenised output, packing, sharding, search and dedup."""
