"""Column functions: keys, placement, record codecs and formats."""
