"""Training-data operators: de-duplication, packing, archives, sharding, filters, tokens, search."""
