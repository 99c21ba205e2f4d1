"""Training-data operators: archives, near-duplicates, tokens, models, filters."""
