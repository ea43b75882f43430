"""Training-data operators: fingerprints, tokenizers, filters, packing, archives, chat, dedup."""
