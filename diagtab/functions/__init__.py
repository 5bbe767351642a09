"""Column expressions: text cleaning, identifiers, word lists."""
