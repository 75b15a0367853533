"""DataFrame operators of the n-gram store and language model."""
