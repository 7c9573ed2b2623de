"""Column expressions: codecs, headers, identifiers, status texts, retry delays."""
