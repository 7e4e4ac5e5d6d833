"""Training-data operators: archives, scoring, duplicates, quality, mixing and tokens."""
