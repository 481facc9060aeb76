"""Column builders: text, patent numbers, dates and hashes, all built-in expressions."""
