"""Training-data operators: dedup, packing, quality, sharding, tokens, chat, HTML."""
