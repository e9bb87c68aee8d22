"""Column expressions: URL keys, text tokens, languages, sketches."""
