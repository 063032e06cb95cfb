"""Column expressions: arrays, hashing, phrases, text fields, scores."""
