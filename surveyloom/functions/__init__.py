"""Column-level functions: cleaning, recoding, money and text."""
