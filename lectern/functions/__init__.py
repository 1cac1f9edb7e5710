"""Column functions: text, identity hashes, vectors."""
