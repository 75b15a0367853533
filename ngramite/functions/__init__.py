"""Column expressions: hashing, codecs, bits and probabilities."""
