"""Training-data operators (deduplication, mixing, extraction, filtering,
classification, tokenising).  Nothing outside this subpackage imports it."""
