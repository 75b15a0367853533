"""Reading and writing: key/value text, saved models, scratch tables."""
