"""Column functions: parsing of answers, ids and hashes, pixel arrays."""
