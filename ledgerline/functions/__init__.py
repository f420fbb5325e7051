"""Column functions: text, names and scores."""
