"""Column functions: cleaning, codes, hashing, text and map projection."""
